"""Contexts under a budget (T14, T15) against plain text assembly."""

import random

import pytest
from pyspark.sql import functions as F

from plantwise.operators.context import context_all_sources, context_by_group, row_lines

MARK = "\n...[CONTEXTO TRUNCADO]"


def cut(text, budget):
    return text[:budget] + MARK if len(text) > budget else text


def plain(rows, budget):
    """Lines of rows (group, key, line), keys unique per group."""
    out = {}
    for g in {r[0] for r in rows}:
        lines = [r[2] or "" for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))]
        out[g] = cut("\n".join([f"--- {'' if g is None else g} ---", *lines]), budget)
    return out


def run(spark, rows, budget, partitions=6):
    df = spark.createDataFrame(rows, "g int, pos int, line string").repartition(partitions)
    found = context_by_group(df, "g", ["pos"], F.col("g"), budget).collect()
    assert len(found) == len({r.g for r in found})
    return {r.g: r.context for r in found}


@pytest.mark.parametrize("budget", [1, 9, 10, 11, 60, 300, 5000])
def test_groups_of_all_sizes(spark, budget):
    rnd = random.Random(budget)
    rows = [(g, i, "é" * rnd.randrange(8) or None) for g in (1, 2, None) for i in range(rnd.randrange(1, 60))] + [(7, None, "sem chave"), (7, 1, "b")]
    assert run(spark, rows, budget) == plain(rows, budget)


def test_hot_group_over_many_ranges(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rnd = random.Random(7)
        rows = [(1, i, "z" * rnd.randint(0, 9)) for i in range(50_000)] + [(2, i, "w") for i in range(3)]
        rnd.shuffle(rows)
        assert run(spark, rows, 30_000) == plain(rows, 30_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_and_repeated_keys_lose_and_multiply_nothing(spark):
    # lines of one key have no order of their own, so they are compared as a set
    rows = [(1, 1, "aa"), (1, 1, "bb"), (1, 2, "c"), (2, None, "x"), (2, None, "y"), (2, 5, "z"), (3, 1, "copy"), (3, 1, "copy"), (3, 1, "copy"), (3, 0, "top")]
    got = {g: c.split("\n") for g, c in run(spark, rows, 1000).items()}
    assert got[1][0] == "--- 1 ---" and sorted(got[1][1:3]) == ["aa", "bb"] and got[1][3:] == ["c"]
    assert sorted(got[2][1:3]) == ["x", "y"] and got[2][3:] == ["z"]
    assert got[3] == ["--- 3 ---", "top", "copy", "copy", "copy"]
    many = [(1, None, "the same line")] * 4000 + [(1, 1, "last")]
    assert run(spark, many, 100)[1] == cut("--- 1 ---\n" + "the same line\n" * 4000 + "last", 100)
    assert run(spark, many, 10**6)[1] == "--- 1 ---\n" + "the same line\n" * 4000 + "last"


@pytest.mark.parametrize("budget", [5, 12, 13, 60, 200, 10_000])
def test_all_sources_with_null_and_repeated_keys(spark, budget):
    data = {"um": [(i, "x" * (i % 5)) for i in range(40)], "vazio": [], "dois": [(None, "primeira"), (1, "curta"), (2, "igual"), (2, "igual"), (3, "z" * 30)]}
    sources = [(n, spark.createDataFrame(rows, "k int, line string").repartition(3)) for n, rows in data.items()]
    text = "\n".join(part for n, rows in data.items() if rows for part in [f"--- {n} ---", *(line for _, line in rows)])
    got = context_all_sources(sources, ["k"], budget).collect()
    assert [r.context for r in got] == [cut(text, budget)]


def test_no_source_has_rows(spark):
    empty = spark.createDataFrame([], "k int, line string")
    assert [r.context for r in context_all_sources([("a", empty)], ["k"]).collect()] == [""]


def test_rows_render_every_column(spark):
    df = spark.createDataFrame([(1, None, " ", "b"), (2, 0.5, "a", None)], "id int, v double, s string, t string")
    assert [r.line for r in row_lines(df).collect()] == ["id: 1 | t: b", "id: 2 | v: 0.5 | s: a"]
