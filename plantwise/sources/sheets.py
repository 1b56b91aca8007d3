"""Sheet and record sources.

Sheets arrive as CSV exports (one file or a folder of files per sheet). They are read
with a declared all-text schema -- never inferred -- and addressed by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def positional_schema(n_cols: int, prefix: str = "c") -> StructType:
    return StructType([StructField(f"{prefix}{i}", StringType(), True) for i in range(n_cols)])


def read_sheet_csv(spark: SparkSession, path: str | list[str], n_cols: int, header: bool = False) -> DataFrame:
    """Positional text scan. Title/header/leading junk lines are not skipped by
    position (a distributed scan has no global row order); they fail the validity
    predicates of the cleaning step instead (their date cell does not parse)."""
    return (
        spark.read.schema(positional_schema(n_cols))
        .option("header", "true" if header else "false")
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .csv(path)
    )


def read_skipping(spark: SparkSession, path: str | list[str], n_cols: int, k: int) -> DataFrame:
    """Every file without its first ``k`` lines (blank ones count), by position, whatever they hold.

    Files stay splittable: a line's number counts only in the split that begins its file, where Spark
    reads lines in order; the first number of each such split is one row per file. Cells with line
    breaks need ``read_record_sheet``."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    starts = lines.where(F.col("block") == 0).groupBy("file").agg(F.min("no").alias("first")).withColumnRenamed("file", "own")
    later = (F.col("block") > 0) | (F.col("no") >= F.col("first") + k)
    kept = lines.join(starts, F.col("file") == F.col("own"), "left").where(later & (F.trim("value") != ""))
    schema = ", ".join(f"{c} string" for c in positional_schema(n_cols).names)
    return kept.select(F.from_csv("value", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_record_sheet(spark: SparkSession, path: str | None, name: str = "") -> DataFrame:
    """Header row -> records, every cell text. A missing source gives an empty
    frame (and a warning), not a failure."""
    import warnings

    from plantwise.sources.staging import exists

    if not path or not exists(spark, path):
        warnings.warn(f"record sheet {name or path!r} not found; using an empty frame", stacklevel=2)
        return spark.createDataFrame([], StructType([]))
    # cells may hold line breaks and doubled quotes; such files can't be split, so large record
    # sheets should be landed as many files
    return (
        spark.read.option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE")
        .option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    )


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """``SELECT *`` of a stored table with a declared schema (missing columns come
    back null; extra columns are not read). An absent table with a declared schema is empty."""
    from plantwise.sources.staging import exists

    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """S6 + U1: rows per named source as one union of per-source counts (partial counts
    per source, no data movement beyond one row per source and task)."""
    out = None
    for name, df in sources.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return out


def source_profile(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """S3: every file of a folder of sheets: rows, widest row in fields (shape guard: the machine column is
    only meaningful when the sheet has more than one column), and modification time. A record whose quoted
    cells hold separators or line breaks is one row of its own width (see ``records``); large files are
    read split by split."""
    from plantwise.sources.records import records, width

    per_file = records(spark, folder).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.max(width("text")).alias("n_cols"))
    times = spark.read.text(folder).groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.max("_metadata.file_modification_time").alias("modified"))
    return times.join(per_file, F.col("file_path") == F.col("file"), "left").select(
        "file_path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_cols", "modified", (F.col("n_cols") > 1).alias("has_machine_column"))
