"""Records of quoted text files that are read by many tasks.

A line break inside a quoted cell is no record end, and whether a split of a file begins inside such a
cell depends on all quotes before it. Files are still read split by split:

1. one pass adds up the quotes of every split (one number per split); the running sum over a file's
   splits tells which of them begin inside a cell;
2. a second pass goes through each split's lines in order, from that state, and joins lines of one
   record; only records that cross a split's end leave their task, as at most two pieces per
   split, and are put together by the split that began them.

The order of lines inside a task is the one thing Spark's expressions can't use without a shuffle of all
lines, so the second pass is a small Arrow function; parsing is Spark's own again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RECORD = "file string, block bigint, no bigint, part string, text string"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")


def quotes(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit('"'), F.lit("")))


def open_splits(lines: DataFrame) -> DataFrame:
    """``file, block`` of the splits that begin inside a quoted cell."""
    odd = lines.groupBy("file", "block").agg((F.sum(quotes("value")) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("open", F.sum("odd").over(earlier) % 2).where("open = 1").select("file", "block")


def line_joiner():
    """The Arrow function of the second pass. It is made here, so that it travels to the tasks by value and
    they need no copy of this package."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines (file, block, no, value, open) in order -> whole records, and the pieces of those that cross
        a split: ``head`` (begins here), ``middle`` (the whole split) and ``tail``."""
        import pyarrow as pa

        names = ("file", "block", "no", "part", "text")
        split, held, first, inside, whole = None, [], None, False, True
        out = ([], [], [], [], [])

        def emit(part: str) -> None:
            for column, value in zip(out, (*split, first, part, "\n".join(held))):
                column.append(value)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "block", "no", "value", "open")))
            for file, block, no, value, opened in rows:
                if split != (file, block):
                    if held:  # the last record of a split runs on into the next
                        emit("head" if whole else "middle")
                    split, held, inside, whole = (file, block), [], bool(opened), not opened
                if not held:
                    first = no
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    emit("whole" if whole else "tail")
                    held, whole = [], True
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)
                out = ([], [], [], [], [])
        if held:
            emit("head" if whole else "middle")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)

    return pieces


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, no, text``: every record of the files, blank lines between records left out. A quote
    that is never closed runs to its file's end, as one record."""
    lines = lines_of(spark, path)
    starts = open_splits(lines).withColumn("open", F.lit(True))
    flagged = lines.join(starts, ["file", "block"], "left").select("file", "block", "no", "value", F.coalesce("open", F.lit(False)).alias("open"))
    found = flagged.sortWithinPartitions("file", "block", "no").mapInArrow(line_joiner(), RECORD)
    whole = found.where("part = 'whole'").drop("part")
    # at most two pieces per split: a tail belongs to the last head before it
    order = Window.partitionBy("file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = found.where("part <> 'whole'")
    began = F.last(F.when(F.col("part") == "head", F.struct("block", "no")), ignorenulls=True).over(order)
    joined = cut.withColumn("began", began).groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("block", "no", "text"))).alias("p"))
    joined = joined.select("file", "began.block", "began.no", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined).where(F.trim("text") != "")


def width(text: str) -> Column:
    """Fields of a record: separators outside quoted cells, and one."""
    outside = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1


def read_record_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S4 over large files: header row -> records, every cell text, each file read by as many tasks as it
    has splits. Every file begins with the header."""
    found = records(spark, path)
    first = found.where("block = 0").groupBy("file").agg(F.min_by("text", "no").alias("header"), F.min("no").alias("first"))
    header = first.select("header").limit(1).collect()  # one line
    if not header:
        return spark.createDataFrame([], "")
    names = spark.range(1).select(F.from_csv(F.lit(header[0][0]), ", ".join(f"c{i} string" for i in range(header[0][0].count(",") + 1)), {"escape": '"'}).alias("r")).select("r.*").first()
    schema = ", ".join(f"`{n}` string" for n in names if n is not None)
    rows = found.join(first.withColumnRenamed("file", "own"), F.col("file") == F.col("own"), "left").where((F.col("block") > 0) | (F.col("no") > F.col("first")))
    return rows.select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
