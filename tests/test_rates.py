"""As-of rates in one stream (J2) and conversion at the moment (T4, T5)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plantwise.operators import mentions as mn
from plantwise.operators import rates
from plantwise.plans.catalog import QUERIES
from plantwise.sources import fixtures as fxt
from tests.conftest import SF_MID, SF_SMALL

QUOTE = "pair string, ts timestamp_ntz, quote_id bigint, rate double"
BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("query", ["fx_asof"])
def test_every_source_is_scanned_once(spark, query):
    plan = executed(QUERIES[query](spark, SF_SMALL))
    assert plan.count("FileScan") <= 3 and "ReusedExchange" in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("bucket", [1, 7, 300, 86_400, 10_000_000])
def test_random_quotes_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(rates, "SPAN_BITS", 3)  # carries cross many spans
    rnd = random.Random(bucket)
    pairs = ["hot"] * 9 + ["cold", ""]

    def quotes(first):
        return [(rnd.choice(pairs), at(rnd.randrange(0, 20_000, 50)), first + i, None if i % 17 == 0 else float(first + i)) for i in range(60)]

    q1, q2 = quotes(0), quotes(1000)
    demands = [(rnd.choice(pairs), at(rnd.randrange(-500, 30_000, 25)), i, "text") for i in range(300)]
    odd = [(None, at(50), 1000, "no pair"), ("hot", None, 1001, "no time"), ("new", at(9_000), 1002, "unknown pair")]
    frames = [spark.createDataFrame(q + [(None, at(1), 5, 1.0), ("hot", None, 6, 1.0)], QUOTE) for q in (q1, q2)]
    asked = spark.createDataFrame(demands + odd, "pair string, ts timestamp_ntz, event_id bigint, note string")
    out = rates.fx_asof(*frames, asked.repartition(3), 600, 3600, bucket_seconds=bucket)
    got = {r.event_id: (r.rate, r.source, r.note) for r in out.collect()}
    assert len(got) == len(demands) + 3

    def newest(qs, pair, t, age):
        own = [q for q in qs if q[0] == pair and q[1] <= t]
        best = max(own, key=lambda q: (q[1], q[2])) if own else None
        return best[3] if best and (t - best[1]).total_seconds() < age else None

    for pair, t, eid, note in demands:
        p, s = newest(q1, pair, t, 600), newest(q2, pair, t, 3600)
        want = (p, "primary") if p is not None else ((s, "secondary") if s is not None else (None, None))
        assert got[eid] == (*want, note), (eid, pair, t)
    assert all(got[eid][:2] == (None, None) for _, _, eid, _ in odd)


def test_fixture_has_gaps_stale_quotes_and_fallback(spark):
    t = fxt.money_text(spark, SF_MID).select("o_orderkey", "order_date", "pair", "asked_at")
    primary, secondary = fxt.money_quotes(spark, SF_MID)
    limits = {"primary_max_age": fxt.PRIMARY_AGE, "secondary_max_age": fxt.SECONDARY_AGE}
    rated = rates.with_rate(t, primary, secondary, ts="asked_at", **limits)
    sources = {r[0]: r[1] for r in rated.groupBy("source").count().collect()}
    assert all(sources.get(s, 0) > 100 for s in ("primary", "secondary", None)), sources
    quoted = primary.union(secondary).select(F.to_date("ts").alias("order_date")).distinct()
    assert t.join(quoted, "order_date", "left_anti").count() > 100  # days without any quote
    unlimited = rates.with_rate(t, primary, secondary, ts="asked_at", primary_max_age=10**9, secondary_max_age=10**9)
    assert unlimited.where("rate is null").count() < sources[None]  # the rest were stale


def test_texts_without_an_amount_or_a_fresh_quote_stay_as_they_are(spark):
    q = spark.createDataFrame([("P", at(0), 1, 5.0)], QUOTE)
    rows = [(i, "custa $10.00", "P", at(60)) for i in range(500)] + [(1000, "nada", "P", at(60)), (1001, "$2", "P", at(10_000))]
    texts = spark.createDataFrame(rows, "id int, text string, pair string, ts timestamp_ntz")
    out = mn.rewrite_texts_asof(texts, q, q.limit(0))
    got = {r.id: r.rewritten for r in out.collect()}
    assert {got[i] for i in range(500)} == {"custa \\$10.00 (R\\$ 50,00)\n(valores sem impostos)"}
    assert got[1000] == "nada" and got[1001] == "$2"  # no amount; no fresh quote
    groups = mn.converted_by_group_asof(mn.explode_mentions(texts, keep=("pair", "ts")), q, q.limit(0), ("pair",)).collect()
    assert [tuple(r) for r in groups] == [("P", 501, 501, 500, 5002.0, 25_000.0)]
