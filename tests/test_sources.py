"""Leading lines skipped by position (S2) and the clustered layout."""

import random

import pytest
from pyspark.sql import functions as F

from plantwise.sources.layout import write_clustered
from plantwise.sources.sheets import read_skipping
from tests.test_browse import leaves


@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_leading_lines_of_every_file_are_skipped(spark, tmp_path, k):
    want = []
    for f, n in (("a b.csv", 5), ("b.csv", 0), ("c.csv", 4000), ("d.csv", 2)):
        lines = ["TITULO,,", "", "Cod,Nome,X"] + [f'K{i},"nome, ""{f}"" {i}",{i}' for i in range(n)]
        (tmp_path / f).write_text("\n".join(lines) + "\n")
        for line in lines[k:]:
            if line.startswith("K"):
                i = line[1:line.index(",")]
                want.append((f"K{i}", f'nome, "{f}" {i}', i))
            elif line:
                want.append(tuple(x or None for x in line.split(",")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # the third file is several splits
    try:
        got = read_skipping(spark, str(tmp_path), 3, k)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def scanned(df):
    """Files and rows that the scan of ``df`` read."""
    out = df.collect()
    scan = [x for x in leaves(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "FileSourceScanExec"]
    metric = lambda name: int(scan[0].metrics().apply(name).value())
    return out, metric("numFiles"), metric("numOutputRows")


def test_lookups_skip_files_and_row_groups(spark, tmp_path):
    rnd = random.Random(4)
    n = 240_000
    df = spark.range(0, n, 1, 4).select(
        (F.col("id") % 6).alias("day"), F.concat(F.lit("m"), F.pmod(F.xxhash64("id"), F.lit(400))).alias("machine"),
        F.sha1(F.col("id").cast("string")).alias("tag"), F.col("id").alias("v"))
    plain = str(tmp_path / "plain")
    df.repartition(4).write.partitionBy("day").option("parquet.block.size", str(1 << 18)).parquet(plain)
    path = write_clustered(df, str(tmp_path / "clustered"), ["day"], ["machine"], ["tag"], row_group_bytes=1 << 18)
    tag = rnd.choice(df.where("day = 3").select("tag", "v").limit(50).collect())

    def look(p):
        return scanned(spark.read.parquet(p).where((F.col("day") == 3) & (F.col("tag") == tag.tag)).select("v"))

    (a, files, rows), (b, plain_files, plain_rows) = look(path), look(plain)
    assert [r.v for r in a] == [r.v for r in b] == [tag.v]
    everything = spark.read.parquet(path).inputFiles()
    assert files < len(everything) and rows < plain_rows / 3, (files, rows, plain_rows)
    machine = lambda p: scanned(spark.read.parquet(p).where((F.col("day") == 3) & (F.col("machine") == "m7")).select("v"))
    (a, _, rows), (b, _, plain_rows) = machine(path), machine(plain)
    assert sorted(r.v for r in a) == sorted(r.v for r in b) and rows < plain_rows / 3
    assert sorted(map(tuple, spark.read.parquet(path).select("machine", "tag", "v", "day").collect())) == sorted(
        map(tuple, df.select("machine", "tag", "v", "day").collect()))


def quoted_file(rnd, n):
    rows = [["k", "v", "w"]]
    for i in range(n):
        kind = rnd.random()
        cell = "plain" if kind < 0.6 else 'a "quoted", cell' if kind < 0.8 else "\n".join("x" * rnd.randrange(30) for _ in range(rnd.randrange(1, 6))) + '\n"", end'
        rows.append([str(i), cell, "" if i % 5 else "z,z"])
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c
    return "\n".join(",".join(map(quote, r)) for r in rows) + "\n"


@pytest.mark.parametrize("split", [64, 1000, 40_000])
def test_records_across_splits_equal_the_multi_line_reader(spark, tmp_path, split):
    from plantwise.sources.records import lines_of, read_record_files
    from plantwise.sources.sheets import read_record_sheet, source_profile

    rnd = random.Random(split)
    n = 120 if split == 64 else 4000
    (tmp_path / "one.csv").write_text(quoted_file(rnd, n))
    (tmp_path / "two.csv").write_text(quoted_file(rnd, 7) + "\n\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert lines_of(spark, str(tmp_path)).select("file", "block").distinct().count() >= 4
        out = read_record_files(spark, str(tmp_path))
        got = sorted(map(str, (tuple(r) for r in out.collect())))
        profile = {r.file_path[-7:]: (r.n_rows, r.n_cols, r.has_machine_column) for r in source_profile(spark, str(tmp_path)).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    whole = read_record_sheet(spark, str(tmp_path))
    assert out.columns == whole.columns
    assert got == sorted(map(str, (tuple(r) for r in whole.collect())))
    assert profile == {"one.csv": (n + 1, 3, True), "two.csv": (8, 3, True)}


def test_profile_of_records_that_all_span_lines_and_unclosed_quotes(spark, tmp_path):
    from plantwise.sources.sheets import source_profile

    (tmp_path / "a.csv").write_text('"x\ny",1,"p\nq"\n"u\nv",2,"r\n\ns"\n')
    (tmp_path / "b.csv").write_text('a,b\n"never closed,\nto the end\n')
    (tmp_path / "c.csv").write_text("")
    got = {r.file_path[-5:]: (r.n_rows, r.n_cols) for r in source_profile(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (2, 3), "b.csv": (2, 2)}
