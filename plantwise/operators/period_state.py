"""Means of any period from the stream's slot sums, by two lookups per period.

Slot sums (ST2) become one row per shift, weekday and calendar day: the sums over active slots of that
day, and running sums up to it. Days are dense, so the figures of a period are the difference of two
rows per shift and weekday, at its last day and the day before its first; day types are sums of
weekdays. The table grows with the calendar, not with the facts, which are never read, and the two
days of a period are a filter pushed to its scan. ``next_day`` and ``previous_day`` are the nearest days with any row.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plantwise.session import shared_dir

MEASURES = ("n", "teep", "oee")
DAY = dt.timedelta(days=1)
NEVER = dt.date(9999, 12, 31), dt.date(1900, 1, 1)  # first and last day of an empty calendar


def as_day(d: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def calendar_sums(sums: DataFrame) -> DataFrame:
    """The state table from slot sums (data, hora, turno, oee_sum, teep_sum, n_rows)."""
    total = F.sum("oee_sum").over(Window.partitionBy("data", "hora"))
    flagged = sums.withColumn("active", F.coalesce(total > 0, F.lit(False)))
    own = {"n": "n_rows", "teep": "teep_sum", "oee": "oee_sum"}
    daily = flagged.groupBy("data", "turno").agg(
        *(F.sum(F.when(F.col("active"), F.col(c))).alias(m) for m, c in own.items()), F.sum("n_rows").alias("present"))
    # one row of bounds and shifts, exploded: no join is needed for the calendar
    bounds = daily.agg(F.min("data").alias("lo"), F.max("data").alias("hi"), F.collect_set("turno").alias("shifts")).where("lo IS NOT NULL")
    grid = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"), "shifts").select("day", F.explode("shifts").alias("turno"))
    met = grid.join(daily, (grid["day"] == daily["data"]) & grid["turno"].eqNullSafe(daily["turno"]), "left").select(
        grid["day"], grid["turno"], "present", *(F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES))
    each = met.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    mine = F.col("weekday") == F.weekday("day")
    each = each.withColumns({m: F.when(mine, F.col(m)).otherwise(F.lit(0)) for m in MEASURES} | {"present": F.when(mine, F.col("present"))})
    upto = Window.partitionBy("turno", "weekday").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("present") > 0, F.col("day"))
    near = Window.partitionBy("turno", "weekday").orderBy("day")
    return each.select(
        "turno", "weekday", "day", *MEASURES, *(F.sum(m).over(upto).alias(f"cum_{m}") for m in MEASURES),
        F.last(here, ignorenulls=True).over(upto).alias("previous_day"),
        F.first(here, ignorenulls=True).over(near.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("next_day"))


@dataclass
class PeriodState:
    spark: SparkSession
    folder: str
    first: dt.date | None
    last: dt.date | None

    @classmethod
    def build(cls, sums: DataFrame, folder: str | None = None) -> PeriodState:
        spark = sums.sparkSession
        folder = folder or shared_dir(spark, f"plantwise-periods/{uuid.uuid4().hex}")
        calendar_sums(sums).write.mode("overwrite").parquet(folder)
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PeriodState:
        lo, hi = spark.read.parquet(folder).agg(F.min("day"), F.max("day")).first()  # two dates
        return cls(spark, folder, lo, hi)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def bounds(self, start: dt.date | str | None, end: dt.date | str | None, closed: str = "both") -> tuple[dt.date, dt.date]:
        """First and last day of a period within the calendar (the first may be after the last: empty)."""
        first, last = self.first or NEVER[0], self.last or NEVER[1]
        lo = first if start is None else max(as_day(start), first)
        hi = last if end is None else min(as_day(end) - (DAY if closed == "left" else dt.timedelta()), last)
        return lo, hi

    def differences(self, periods: Sequence[tuple], by: Sequence[str], weekdays_below: int | None) -> DataFrame:
        """Sums of every period (start, end, closed), ``{measure}{i}`` and its first and last day with rows,
        per ``by``: one scan of at most two days per period."""
        spans = [self.bounds(*p) for p in periods]
        days = sorted({d for lo, hi in spans if lo <= hi for d in (lo - DAY, lo, hi)})
        rows = self.rows().where(F.col("day").isin(days) if days else F.lit(False))
        if weekdays_below is not None:
            rows = rows.where(F.col("weekday") < weekdays_below)
        aggs = []
        for i, (lo, hi) in enumerate(spans):
            real = F.lit(lo <= hi)
            at_end, before = real & (F.col("day") == F.lit(hi)), real & (F.col("day") == F.lit(lo - DAY))
            for m in MEASURES:
                cum = F.col(f"cum_{m}")
                aggs.append(F.sum(F.when(at_end, cum).when(before, -cum).otherwise(F.lit(0))).alias(f"{m}{i}"))
            inside = F.col("next_day").between(F.lit(lo), F.lit(hi)), F.col("previous_day").between(F.lit(lo), F.lit(hi))
            aggs.append(F.min(F.when(real & (F.col("day") == F.lit(lo)) & inside[0], F.col("next_day"))).alias(f"first{i}"))
            aggs.append(F.max(F.when(at_end & inside[1], F.col("previous_day"))).alias(f"last{i}"))
        return rows.groupBy(*by).agg(*aggs)

    def means(self, start=None, end=None, closed: str = "both", by: Sequence[str] = (), weekdays_below: int | None = None) -> DataFrame:
        """A1 (no ``by``) and A2 (``turno``): rows over active slots and their means in a period."""
        found = self.differences([(start, end, closed)], by, weekdays_below)
        n = F.nullif(F.col("n0"), F.lit(0))
        out = found.select(*by, F.coalesce("n0", F.lit(0)).cast("bigint").alias("n_rows"), (F.col("teep0") / n).alias("teep_mean"), (F.col("oee0") / n).alias("oee_mean"))
        return out.where("n_rows > 0") if by else out

    def day_means(self, start=None, end=None, closed: str = "both", weekdays_below: int | None = None) -> DataFrame:
        """A3: per date and shift."""
        lo, hi = self.bounds(start, end, closed)
        rows = self.rows().where(F.col("day").between(F.lit(lo), F.lit(hi)) & (F.col("n") > 0))
        if weekdays_below is not None:
            rows = rows.where(F.col("weekday") < weekdays_below)
        return rows.select(F.col("day").alias("data"), "turno", F.col("n").cast("bigint").alias("n_rows"),
                           (F.col("teep") / F.col("n")).alias("teep_mean"), (F.col("oee") / F.col("n")).alias("oee_mean"))

    def period_means(self, periods: dict[str, tuple], weekdays_below: int | None = None) -> DataFrame:
        """Several periods ``name -> (start, end, closed)`` with their first and last day present."""
        found = self.differences(list(periods.values()), (), weekdays_below)
        each = [F.struct(F.lit(i + 1).alias("period_order"), F.lit(name).alias("period"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("n_rows"),
                         (F.col(f"teep{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("teep_mean"), F.col(f"first{i}").alias("first_date"),
                         F.col(f"last{i}").alias("last_date")) for i, name in enumerate(periods)]
        return found.select(F.inline(F.array(*each)))
