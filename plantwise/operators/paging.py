"""Pages of a table by an explicit order key, from a persisted sparse index (L2).

``build`` sorts the rows by range once and writes them partitioned by range, each row with its place
in its range, and beside them one index row per range: the rows before it, its own rows and the
total. The number of ranges follows the number of rows (``ROWS_PER_RANGE``).

A page is then a join of the index rows that overlap it (at most as many as the page has rows, so
they are broadcast) with the table, whose other ranges dynamic partition pruning leaves
unread: page 100,000 costs what page 1 costs. Building the query runs no job, no offset is
skipped by a top-k, and nothing but the index rows of one page reaches the driver.

Rows of one key stand in the order of a hash of the whole row; only equal rows have no order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plantwise.session import shared_dir
from plantwise.sources.staging import exists

ROWS_PER_RANGE = 1_000_000
INDEX = "range int, first_row bigint, n_rows bigint, n_total bigint"


@dataclass
class PageIndex:
    spark: SparkSession
    folder: str
    schema: StructType

    def rows(self) -> DataFrame:
        """All rows with ``range`` and ``at``, their place in it."""
        own = [StructField("at", LongType()), StructField("range", IntegerType())]
        return self.spark.read.schema(StructType([*self.schema.fields, *own])).parquet(f"{self.folder}/rows")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")

    def page(self, page: int = 1, size: int = 20) -> DataFrame:
        """One page with ``showing first_row to last_row of n_total``; a page beyond the last is the last. A
        table of ``size`` rows or fewer is one page."""
        first = (F.col("page") - 1) * size
        sized = self.index().withColumn("n_pages", F.greatest(F.lit(1).cast("bigint"), F.expr(f"(n_total - 1) div {size} + 1")))
        asked = sized.withColumn("page", F.least(F.lit(max(page, 1)).cast("bigint"), F.col("n_pages")))
        # a range has a row at least, so no more than `size` ranges overlap the page
        hit = asked.where((F.col("first_row") <= first + size) & (F.col("first_row") + F.col("n_rows") > first + 1))
        pos = F.col("first_row") + F.col("at") - 1
        found = self.rows().join(F.broadcast(hit), "range").where((pos > first) & (pos <= first + size))
        return found.orderBy(pos).select(
            *(F.col(c) for c in self.schema.names), "page", "n_pages", (first + 1).alias("first_row"),
            F.least(first + size, F.col("n_total")).alias("last_row"), "n_total")

    def page_numbers(self, size: int = 20) -> DataFrame:
        """Every row with its 1-based position and page."""
        pos = F.col("first_row") + F.col("at") - 1
        return self.rows().join(self.index().select("range", "first_row"), "range").select(
            *(F.col(c) for c in self.schema.names), pos.alias("row_pos"), F.expr(f"(first_row + at - 2) div {size} + 1").alias("page"))


def build(df: DataFrame, key: str | Sequence[str], folder: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> PageIndex:
    """The index of ``df`` in ``folder`` (a new one under the shared folder by default); one that is there
    already is used as it is."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    folder = folder or shared_dir(spark, f"plantwise-pages/{uuid.uuid4().hex}")
    found = PageIndex(spark, folder, df.schema)
    if exists(spark, f"{folder}/index/_SUCCESS"):
        return found
    ranges = max(1, -(-df.count() // rows_per_range))
    order = [*(F.col(k) for k in keys), F.xxhash64(*df.columns)]
    number, task = F.monotonically_increasing_id(), F.spark_partition_id()
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "*", (number - F.shiftleft(task.cast("bigint"), 33) + 1).alias("at"), task.alias("range"))
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{folder}/rows")
    # one row per range: a million rows each, so this window is a millionth of the table
    counts = found.rows().groupBy("range").agg(F.count(F.lit(1)).alias("n_rows"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    first = F.coalesce(F.sum("n_rows").over(by_range), F.lit(0)) + 1
    counts.select("range", first.alias("first_row"), "n_rows", total.alias("n_total")).write.mode("overwrite").parquet(f"{folder}/index")
    return found
