"""Browsing and profiling.

Row order is always an explicit key: a distributed table has no row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from plantwise.operators.paging import build

# The technical-sheet table schema (column, type).
SPEC_SCHEMA = StructType(
    [StructField("id", LongType())]
    + [StructField(n, StringType()) for n in ("referencia", "produto", "decoracao", "data_cadastro")]
    + [StructField(n, DoubleType()) for n in ("tempo_s", "cyan", "magenta", "yellow", "black", "white", "varnish",
                                              "largura", "altura", "diametro")]
    + [StructField(n, StringType()) for n in ("print_edge", "powergrade", "finish_time", "intervalo", "uv_lamp",
                                              "obs", "image_path")]
)


TRACKED = 10_000  # values of the frequent-items summary
ERROR = 3.5  # its error bound times the tracked values, over all rows
VALUE_PARTS = 64  # parts into which the distinct values of a column are dealt


def head_tail(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """L1: first and last ``n`` rows by an explicit order key (top-k per task, no full
    sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    head = df.orderBy(*keys).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.col(k).desc() for k in keys]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def paginate(df: DataFrame, key: str | Sequence[str], page: int = 1, size: int = 20, folder: str | None = None) -> DataFrame:
    """L2: one page by an explicit order key, with ``showing a to b of n`` (see ``paging``). With a
    ``folder``, the index written there serves every later page."""
    return build(df, key, folder).page(page, size)


def page_numbers(df: DataFrame, key: str | Sequence[str], size: int = 20, folder: str | None = None) -> DataFrame:
    """L2 for every row: its 1-based position and page."""
    return build(df, key, folder).page_numbers(size)


def distinct_values(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """A10: distinct text values of a column, nulls dropped, sorted as text."""
    name = out or column
    return df.select(F.col(column).cast("string").alias(name)).dropna().distinct().orderBy(name)


def full_counts_top(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)


def value_counts_top(df: DataFrame, column: str, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values (nulls are a value; ties broken by value) -- a top-k report.

    Two passes, both exact in the end. The first is a frequent-items summary of at most ``tracked``
    values per task, merged: a value it doesn't hold occurs at most ``ERROR / tracked`` of all rows,
    and one it holds at most its estimate. The second counts only the summary's likeliest
    values, bounded and broadcast. If the k-th exact count is above whatever any other value can
    reach, the result is proven; if not (many values, none frequent), all values are counted."""
    value = F.col(column)
    asked = min(max(4 * k, 64), tracked)
    summary = df.agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", value.cast("string"), F.lit(asked), F.lit(tracked)).alias("top")).first()
    found = [(r["item"], r["count"]) for r in summary["top"] or [] if r["item"] is not None]
    rest = ERROR / tracked * summary["n"]  # of values the summary lost
    if len(found) >= asked:
        rest = max(rest, min(c for _, c in found))  # of values it holds that were not asked for
    spark = df.sparkSession
    likely = spark.createDataFrame([(v,) for v, _ in found], "item string")
    met = df.select(value.alias("value")).join(F.broadcast(likely), F.col("value").cast("string") == F.col("item"), "left")
    exact = met.where("item IS NOT NULL OR value IS NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = exact.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k).collect()  # k rows
    if len(top) == k and top[-1]["n"] > rest:
        return spark.createDataFrame(top, exact.schema).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return full_counts_top(df, column, k)


def point_lookup(df: DataFrame, equals: dict[str, object], columns: Sequence[str] | None = None) -> DataFrame:
    """conjunctive equality filter, then projection (pushed to the scan)."""
    cond: Column = F.lit(True)
    for c, v in equals.items():
        cond = cond & (F.col(c) == F.lit(v))
    out = df.filter(cond)
    return out.select(*columns) if columns else out


def substring_one(df: DataFrame, column: str, term: str) -> DataFrame:
    """distinct values of one column whose text contains ``term``."""
    text = F.col(column).cast("string")
    return df.select(text.alias(column)).filter(F.col(column).contains(term)).distinct()


def substring_all_columns(df: DataFrame, term: str, sample: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """F13 + U2: for every column, how many rows contain ``term`` and up to ``sample``
    distinct matching values (the smallest ones); columns without a match are omitted.

    One scan: unpivot to (column, value), filter, count per distinct value (partial aggregation). The
    values are dealt by hash into parts of a column, each part keeps its count and its ``sample``
    smallest values, and a column adds up its parts, so no task sees a column's distinct values whole.
    """
    cols = list(columns or df.columns)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], cols, "column_name", "value")
    counts = long.filter(F.col("value").contains(term)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    part = F.pmod(F.xxhash64("value"), F.lit(VALUE_PARTS)).alias("part")
    by_part = Window.partitionBy("column_name", "part")
    ranked = counts.select("column_name", part, "value", "c").select(
        "column_name", "part", "value", F.row_number().over(by_part.orderBy("value")).alias("no"), F.sum("c").over(by_part).alias("c"))
    kept = ranked.filter(F.col("no") <= sample).groupBy("column_name", "part").agg(
        F.first("c").alias("c"), F.collect_list("value").alias("smallest"))
    return kept.groupBy("column_name").agg(
        F.sum("c").alias("n_matches"),
        F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("smallest"))), 1, sample), ", ").alias("sample_values"))


def ink_per_thousand(spec: DataFrame, inks: Sequence[tuple[str, str]],
                     keys: Sequence[str] = ("id", "referencia", "produto")) -> DataFrame:
    """C11: ink use per unit (ml) and per thousand units (ml x 1000), long form with
    friendly ink names instead of column names."""
    names = F.create_map(*[F.lit(x) for pair in inks for x in pair])
    long = spec.select(*keys, *[c for c, _ in inks]).unpivot(list(keys), [c for c, _ in inks], "ink_column", "ml_per_unit")
    return long.select(
        *keys,
        F.element_at(names, F.col("ink_column")).alias("ink"),
        "ml_per_unit",
        (F.col("ml_per_unit") * F.lit(1000.0)).alias("ml_per_thousand"),
    )
