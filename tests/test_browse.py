"""Pages by a persisted index (L2), searches and lookups."""

import random

import pytest
from pyspark.sql import functions as F

from plantwise.operators import browse, paging


def jobs_of(spark, action):
    """Result and number of jobs that ``action`` starts."""
    sc = spark.sparkContext
    group = f"g{random.random()}"
    sc.setJobGroup(group, "test")
    try:
        return action(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def leaves(plan):
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if not children.size():
                out.append(node)
    return out


def test_paginate_edges(spark):
    for n, expect_pages in ((0, 1), (20, 1), (21, 2)):
        df = spark.range(n).withColumnRenamed("id", "k")
        out = browse.paginate(df, "k", page=2, size=20).collect()
        assert all(r.n_pages == expect_pages for r in out)
        assert len(out) == (1 if n == 21 else n)


def test_page_numbers_brute_force(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    index = paging.build(df, "k", rows_per_range=150)
    got = {r.k: (r.row_pos, r.page) for r in index.page_numbers(20).collect()}
    assert got == {k: (k + 1, k // 20 + 1) for k in range(1000)}
    assert index.index().count() == 7


@pytest.mark.parametrize("page, size", [(1, 20), (2, 333), (50, 20), (51, 20), (7, 150), (-3, 10), (10**9, 999), (1, 5000)])
def test_any_page_brute_force(spark, page, size, tmp_path_factory):
    folder = str(tmp_path_factory.getbasetemp() / "pages-1000")
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = browse.paginate(df, "k", page, size, folder).collect()
    pages = max(1, -(-1000 // size))
    page = min(max(page, 1), pages)
    want = list(range(1000))[(page - 1) * size:page * size]
    assert [r.k for r in got] == want
    assert {(r.page, r.n_pages, r.first_row, r.last_row, r.n_total) for r in got} == {(page, pages, want[0] + 1, want[-1] + 1, 1000)}


def test_page_100000_reads_its_range_only(spark):
    df = spark.range(0, 2_100_000, 1, 8).withColumnRenamed("id", "k")
    index = paging.build(df, "k", rows_per_range=80_000)  # 27 ranges: Spark lists more than 32 folders by a job
    query, jobs = jobs_of(spark, lambda: index.page(100_000, 20))
    assert jobs == 0  # nothing runs while the query is built
    assert [r.k for r in query.collect()] == list(range(1_999_980, 2_000_000))
    plan = final_plan(query)
    assert "dynamicpruning" in plan and "TakeOrderedAndProject" not in plan and "map(" not in plan
    read = [int(x.metrics().apply("numPartitions").value()) for x in leaves(query._jdf.queryExecution().executedPlan())
            if x.getClass().getSimpleName() == "FileSourceScanExec" and x.metrics().contains("numPartitions")]
    assert sorted(read)[-1] <= 2, read  # of 27


def test_equal_and_null_keys_are_paged_once_each(spark):
    rows = [(None, i) for i in range(30)] + [(1, i) for i in range(30)] + [(2, 7)] * 5
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    index = paging.build(df, "k", rows_per_range=10)
    seen = [(r.k, r.v) for p in range(1, 8) for r in index.page(p, 10).collect()]
    assert sorted(seen, key=str) == sorted(rows, key=str)
    assert [k for k, _ in seen] == [None] * 30 + [1] * 30 + [2] * 5


def test_search_in_all_columns_scans_once_and_equals_plain(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"v{rnd.randrange(500)}", rnd.randrange(2000), None if i % 7 else f"x{i % 40}12") for i in range(3000)]
    spark.createDataFrame(rows, "a string, b int, c string").write.parquet(str(tmp_path / "t"))
    out = browse.substring_all_columns(spark.read.parquet(str(tmp_path / "t")), "12", 5)
    want = {}
    for at, name in enumerate("abc"):
        hits = [str(r[at]) for r in rows if r[at] is not None and "12" in str(r[at])]
        if hits:
            want[name] = (len(hits), ", ".join(sorted(set(hits))[:5]))
    assert {r.column_name: (r.n_matches, r.sample_values) for r in out.collect()} == want
    assert final_plan(out).count("FileScan") == 1


def test_lookup_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("m1", 1, 0.5), ("m2", 2, 0.7)], "m string, d int, v double").write.parquet(str(tmp_path / "t"))
    out = browse.point_lookup(spark.read.parquet(str(tmp_path / "t")), {"m": "m2", "d": 2}, ["v"])
    assert [r.v for r in out.collect()] == [0.7]
    assert "EqualTo(m,m2)" in final_plan(out)


def plain_top(values, k):
    count = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    return sorted(count.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:k]


@pytest.mark.parametrize("kind", ["frequent", "flat", "few", "null first", "ties"])
@pytest.mark.parametrize("tracked", [64, 10_000])
def test_frequent_values_equal_the_full_count(spark, monkeypatch, kind, tracked):
    rnd = random.Random(9)
    values = {
        "frequent": lambda: [f"hot{rnd.randrange(12)}" if rnd.random() < 0.9 else f"v{rnd.randrange(10**6)}" for _ in range(30_000)],
        "flat": lambda: [f"v{rnd.randrange(20_000)}" for _ in range(30_000)],
        "few": lambda: ["a", "b", "b", None],
        "null first": lambda: [None if rnd.random() < 0.5 else f"h{rnd.randrange(30)}" for _ in range(20_000)],
        "ties": lambda: [f"t{i % 40:02d}" for i in range(20_000)],
    }[kind]()
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    full, calls = browse.full_counts_top, []
    monkeypatch.setattr(browse, "full_counts_top", lambda *a: calls.append(1) or full(*a))
    got = [tuple(r) for r in browse.value_counts_top(df, "v", 10, tracked).collect()]
    assert got == plain_top(values, 10)
    if kind == "flat":
        assert calls  # nothing is frequent enough to be proven by the summary
    if kind == "frequent" and tracked == 10_000:
        assert not calls


def test_frequent_numbers_and_an_empty_table(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(1000)], "v int")
    assert [tuple(r) for r in browse.value_counts_top(df, "v", 3).collect()] == [(i, 143) for i in range(3)]
    assert browse.value_counts_top(df.limit(0), "v", 3).collect() == []
