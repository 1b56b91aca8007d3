"""Bounded text contexts per group.

A context is a group's lines in order, joined by newlines and cut at a number of characters. Which
lines reach it follows from lengths alone, so whole texts cross no shuffle before that is known:

1. every line becomes (group, order, hash, length); equal lines at one place are counted together,
   which makes the rest of the work safe for null and repeated order keys;
2. these numbers are sorted by range of (group, order) -- as many ranges as the session has
   shuffle partitions, so a hot group is as many tasks as its share of the lines -- and written;
3. a line's offset is the sum over its group's earlier ranges (one number per group and range)
   plus the running sum inside its range; ranges that begin beyond the budget are dropped first,
   and lines that begin beyond it after;
4. only the lines left, at most one per character of the budget and group, meet their texts again,
   by a join on all of (group, order, hash, length), each text already cut to the budget.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantwise.functions.text import TRUNCATION_MARK, row_line
from plantwise.sources.staging import written


def row_lines(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (), out_col: str = "line") -> DataFrame:
    """Render each row as ``k: v | k: v`` over ``columns`` (by default all), null and blank values
    skipped."""
    return df.select(*keep, row_line(df.columns if columns is None else columns).alias(out_col))


def offsets(lines: DataFrame, group: list[str], order: list[str], max_chars: int, start: Column) -> DataFrame:
    """Lines that begin inside the budget: their keys, copies, ``_start`` (of the first copy), and ``_total``,
    the group's characters with a newline per line. ``start``: characters before a group's first line."""
    spark = lines.sparkSession
    place = [*group, *order, "_hash", "_size"]
    sized = lines.groupBy(*place).agg(F.count(F.lit(1)).alias("_copies"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(sized.repartitionByRange(ranges, *place).select("*", F.spark_partition_id().alias("_range")), "context-sizes")
    width = F.col("_copies") * (F.col("_size") + 1)
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = placed.groupBy(*group, "_range").agg(F.sum(width).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "_range", (start + before).alias("_before"), F.sum("_sum").over(by_group).alias("_total"))
    # a header alone may fill the budget: a group's first line is kept in any case
    sums = sums.where((F.col("_before") < max_chars) | (F.col("_before") == start)).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_r"), "_before", "_total")
    own = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)), F.col("_range") == F.col("_r"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order, "_hash", "_size").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(sums, own).withColumn("_start", F.col("_before") + F.coalesce(F.sum(width).over(inside), F.lit(0)))
    return near.where((F.col("_start") < max_chars) | (F.col("_start") == start)).select(*place, "_copies", "_start", "_total")


def assembled(lines: DataFrame, group: list[str], order: list[str], line: str, max_chars: int, start: Column) -> DataFrame:
    """Per group ``_body``, its lines joined by newlines as far as they begin inside the budget, and
    ``_total`` (see ``offsets``)."""
    place = [*group, *order, "_hash", "_size"]
    text = F.coalesce(F.col(line), F.lit(""))
    # two hashes and the length stand for a line among those at one place
    keyed = lines.select(*group, *order, text.alias("_text")).select(
        *group, *order, F.struct(F.xxhash64("_text"), F.hash("_text")).alias("_hash"), F.length("_text").alias("_size"),
        F.substring("_text", 1, max_chars).alias("_text"))
    kept = offsets(keyed.drop("_text"), group, order, max_chars, start)
    kept = kept.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(place)), "_copies", "_start", "_total")
    met = keyed.join(kept, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(place))))
    # copies of a line are one member of the set, before and after the shuffle
    parts = met.groupBy(*group).agg(
        F.sort_array(F.collect_set(F.struct("_start", "_copies", "_size", "_text"))).alias("_parts"), F.max("_total").alias("_total"))
    pieces = F.expr(f"""transform(_parts, p -> concat(
        repeat(concat(p._text, '\n'), cast(least(p._copies, ({max_chars} - p._start) div (p._size + 1) + 1) - 1 as int)), p._text))""")
    return parts.select(*group, F.array_join(pieces, "\n").alias("_body"), "_total")


def cut(body: Column, whole: Column, max_chars: int) -> Column:
    """``body``, or its first ``max_chars`` characters and the mark if ``whole`` characters are more."""
    return F.when(whole > max_chars, F.concat(F.substring(F.concat(body, F.lit("\n")), 1, max_chars), F.lit(TRUNCATION_MARK))).otherwise(body)


def context_by_group(lines: DataFrame, group_col: str, order_cols: Sequence[str], name: Column, max_chars: int = 30000,
                     line_col: str = "line") -> DataFrame:
    """Per group ``--- name ---`` then its lines in order, newline-joined; cut at ``max_chars``
    characters (mid-line) with the truncation mark appended. ``name`` is an expression of the group.

    A null line is an empty one. Rows of one order key stand in the order of their texts' hashes, null
    keys first; repeated rows count as often as they occur; a null group is a group."""
    header = F.concat(F.lit("--- "), F.coalesce(name.cast("string"), F.lit("")), F.lit(" ---"))
    found = assembled(lines, [group_col], list(order_cols), line_col, max_chars, F.length(header) + 1)
    body = F.concat(header, F.lit("\n"), F.col("_body"))
    return found.select(group_col, cut(body, F.length(header) + F.col("_total"), max_chars).alias("context"))


def context_all_sources(sources: Sequence[tuple[str, DataFrame]], order_cols: Sequence[str], max_chars: int = 30000,
                        line_col: str = "line") -> DataFrame:
    """One context over all sources under one budget: per source that has rows
    ``--- name ---`` and its lines in order, newline-joined, cut at ``max_chars`` characters with the
    truncation mark appended. One row, ``context``. Null and repeated order keys as in
    ``context_by_group``."""
    order = list(order_cols)
    parts = []
    for no, (name, lines) in enumerate(sources):
        own = lines.select(F.lit(no).alias("_no"), F.lit(1).alias("_row"), *order, F.col(line_col).alias("_line"))
        # a source's header is a line before its first, if it has one
        head = own.limit(1).select(
            "_no", F.lit(0).alias("_row"), *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in order), F.lit(f"--- {name} ---").alias("_line"))
        parts += [own, head]
    found = assembled(reduce(DataFrame.unionByName, parts), [], ["_no", "_row", *order], "_line", max_chars, F.lit(0))
    return found.select(cut(F.col("_body"), F.col("_total") - 1, max_chars).alias("context"))
