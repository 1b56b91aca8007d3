"""Poisson replication at rates of any size, with weights and null sources."""

import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from plantwise.llm import mixture


def count_of(seed, doc_id, rate):
    """Count drawn by inversion in exact-enough logarithms."""
    if rate <= 0:
        return 0
    u = (int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
    first = max(0, math.floor(rate - 12 * math.sqrt(rate) - 40))
    last = math.ceil(rate + 12 * math.sqrt(rate) + 40)
    log = [0.0]
    for k in range(first + 1, last + 1):
        log.append(log[-1] + math.log(rate / k))
    top = max(log)
    p = [math.exp(x - top) for x in log]
    total, at = math.fsum(p), 0.0
    for k, x in enumerate(p, first):
        at += x
        if u < at / total:
            return k
    return last


@pytest.mark.parametrize("rate", [1e-6, 0.01, 0.5, 1.0, 3.7, 40.0, 3000.0, 1e5, 1e7])
def test_table_is_the_distribution_at_any_rate(spark, rate):
    began = time.time()
    table = mixture.count_table(spark.createDataFrame([("s", rate)], "mix_source string, mix_rate double"))
    rows = table.orderBy("k").collect()
    assert time.time() - began < 30
    mean = sum(r.k * (r.high - r.low) for r in rows)
    assert abs(mean - rate) <= 1e-9 * max(rate, 1) + 1e-12
    assert rows[0].low == 0 and rows[-1].high == 1 and all(a.high == b.low for a, b in zip(rows, rows[1:]))
    variance = sum((r.k - rate) ** 2 * (r.high - r.low) for r in rows)
    assert abs(variance / rate - 1) < 1e-6
    if rate < 50:
        assert abs(rows[0].high - math.exp(-rate)) < 1e-14
    guide = mixture.guide_table(table)
    widest = guide.agg(F.max(F.size("mix_choice"))).first()[0]
    assert guide.count() >= mixture.GUIDE and widest <= len(rows)


def test_weights_null_sources_and_odd_weights(spark):
    rows = [(i, "x" * 100, s) for i, s in enumerate(["a", "b", None, "c", "d", "e", "empty", None, "a"])]
    docs = spark.createDataFrame([(i, None if s == "empty" else t, s) for i, t, s in rows], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), (None, 5.0), ("b", 0.0), ("c", -1.0), ("d", float("nan")), ("x", 9.0), ("empty", 4.0)], "s string, w double")
    out = mixture.mix(docs, weights, total=20.0, seed=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    total = 800 * 20.0
    rates = {"a": 3 / 8 * total / 200, None: 5 / 8 * total / 200}
    want = {i: count_of(3, i, rates.get(s, 0.0)) for i, _, s in rows}
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(1, n + 1)) for i, n in want.items() if n}
    assert set(got) <= {0, 2, 7, 8}


@pytest.mark.parametrize("rate", [0.4, 30.0, 9000.0, 250_000.0])
def test_copies_of_large_rates(spark, rate):
    n = 3 if rate > 1000 else 200
    docs = spark.createDataFrame([(i, "x", "s") for i in range(n)], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: (r.n, r.a, r.b, r.d) for r in mixture.mix(docs, total=rate, seed=5).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.count_distinct("copy").alias("d")).collect()}
    assert time.time() - began < 60
    want = {i: count_of(5, i, rate) for i in range(n)}
    assert got == {i: (c, 1, c, c) for i, c in want.items() if c}


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    plan = mixture.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
