"""Aggregations over typed facts.

Means of means keep (sum, count) per inner group (SURVEY 4.1 law 5), so an outer level
can be derived from the inner one without rescanning; several figures that the source
computes in separate passes are conditional aggregates of a single scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantwise.functions.cleaning import weekday_index, weekday_name, weekday_name_pt
from plantwise.operators.activity import slot_state
from plantwise.operators.facts import SHIFTS, WORK_HOURS, in_period

MEASURES = ("teep", "oee")


def _mean_cols(measures: Sequence[str] = MEASURES) -> list[Column]:
    return [F.avg(m).alias(f"{m}_mean") for m in measures]


def means_by(facts: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """A2 (keys=turno) / A3 (keys=data, turno)."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *_mean_cols(measures))


def _active_sums(facts: DataFrame, measures: Sequence[str], by: tuple[str, ...]) -> DataFrame:
    """Sums and counts per slot, shift and ``by`` of the rows in active slots (one scan)."""
    sums = {"n_rows": F.lit(1), **{f"{m}_sum": F.col(m) for m in measures}}
    return slot_state(facts, sums, by).filter("act_global")


def mean_of_means_two_levels(
    facts: DataFrame,
    group_key: str,
    split_key: str = "turno",
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """A4/A5: over active slots, the mean of ``group_key`` means overall (scope 'all') and per
    ``split_key``. One scan: grouping sets (group, split) and (group) of the slot sums give
    the inner (sum, count) of both levels at once."""
    sets = _active_sums(facts, measures, (group_key, split_key)).groupingSets(
        [[group_key, split_key], [group_key]], group_key, split_key).agg(
        F.grouping_id().alias("_gid"),
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(f"{m}_sum").alias(f"{m}_sum") for m in measures],
    )
    scope = F.when(F.col("_gid") == 0, F.col(split_key).cast("string")).otherwise(F.lit("all"))
    return sets.groupBy(scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("n_groups"),
        *[F.avg(F.col(f"{m}_sum") / F.col("n_rows")).alias(f"{m}_mean") for m in measures],
    )


def weighted_group_means(facts: DataFrame, group_key: str = "data", split_key: str = "turno",
                         measure: str = "teep") -> DataFrame:
    """Over active slots, per split the simple mean of group means next to the
    count-weighted one (sum(mean * n) / sum(n), which equals the plain row mean)."""
    inner = _active_sums(facts, (measure,), (group_key, split_key)).groupBy(split_key, group_key).agg(
        (F.sum(f"{measure}_sum") / F.sum("n_rows")).alias("m"), F.sum("n_rows").alias("n")
    )
    return inner.groupBy(split_key).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.avg("m").alias("simple_mean"),
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted_mean"),
    )


def _sorted_text_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def shift_sets(facts: DataFrame, keys: Sequence[str] = ("data", "turno")) -> DataFrame:
    """Per (date, shift) the sorted distinct machines, hours, and hours that have a
    zero-OEE row, plus the row count. Sets are over low-cardinality columns only."""
    hour_int = F.col("hora").cast("int")
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _sorted_text_set(F.col("maquina")).alias("machines"),
        F.array_join(F.transform(F.array_sort(F.collect_set(hour_int)), lambda x: x.cast("string")), ",").alias("hours"),
        F.array_join(
            F.transform(F.array_sort(F.collect_set(F.when(F.col("oee") == 0, hour_int))), lambda x: x.cast("string")),
            ",",
        ).alias("zero_hours"),
    )


def filter_funnel(
    typed: DataFrame,
    period: tuple[str, str],
    shifts: Sequence[str] = SHIFTS,
    hours: tuple[float, float] = WORK_HOURS,
) -> DataFrame:
    """Rows left after each filter (period, shift, hour, activity) in one scan.

    Period, shift and hour are functions of the slot keys, so the counts of every stage and the
    activity of the surviving population come from one table of slot sums. Input: the typed
    sheet (``facts.typed_sheet``)."""
    facts = typed.filter(F.col("machine_ok")).drop("machine_ok")
    in_p = in_period("data", period[0], period[1])
    in_s = in_p & F.col("turno").isin(*shifts)
    in_h = in_s & F.col("hora").between(float(hours[0]), float(hours[1]))
    state = slot_state(facts, {"n": F.lit(1)}, counted=in_h)

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return state.agg(
        rows(F.lit(True)).alias("n_valid"),
        rows(in_p).alias("n_period"),
        rows(in_s).alias("n_shift"),
        rows(in_h).alias("n_hour"),
        rows(in_h & F.col("act_global")).alias("n_active"),
    )


def _stack(df: DataFrame, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """Unpivot one wide aggregate row into several rows (no join, no shuffle)."""
    parts = ", ".join(", ".join(r) for r in rows)
    return df.selectExpr(f"stack({len(rows)}, {parts}) as ({', '.join(names)})")


def threshold_sweep(facts: DataFrame, steps: int = 10, step: float = 0.05, target_oee: float = 0.6247,
                    by: str = "disponibilidade", measure: str = "oee") -> DataFrame:
    """For t = i * step, mean OEE of rows with availability > t and of rows with
    OEE > t, and the distance to a target OEE. One scan, 4 x steps conditional aggregates."""
    aggs: list[Column] = []
    for i in range(steps):
        t = F.lit(float(i * step))
        aggs += [
            F.avg(F.when(F.col(by) > t, F.col(measure))).alias(f"ma{i}"),
            F.count_if(F.col(by) > t).alias(f"na{i}"),
            F.avg(F.when(F.col(measure) > t, F.col(measure))).alias(f"mo{i}"),
            F.count_if(F.col(measure) > t).alias(f"no{i}"),
        ]
    wide = facts.agg(*aggs)
    rows = [(str(i), f"CAST({float(i * step)!r} AS DOUBLE)", f"ma{i}", f"na{i}", f"mo{i}", f"no{i}") for i in range(steps)]
    long = _stack(wide, rows, ["step", "threshold", "oee_mean_avail", "n_avail", "oee_mean_oee", "n_oee"])
    tgt = F.lit(float(target_oee))
    return long.withColumns(
        {
            "diff_avail": F.abs(F.col("oee_mean_avail") - tgt),
            "diff_oee": F.abs(F.col("oee_mean_oee") - tgt),
        }
    )


def scope_means(typed: DataFrame, period: tuple[str, str], shifts: Sequence[str] = SHIFTS,
                hours: tuple[float, float] = WORK_HOURS, validate: bool = False) -> DataFrame:
    """Mean OEE/TEEP under successive scopes, one conditional aggregate each.
    Input: the typed sheet; F1' (no machine test) unless ``validate``."""
    facts = typed.filter(F.col("machine_ok")) if validate else typed
    facts = facts.filter(in_period("data", period[0], period[1]))
    ab = F.col("turno").isin(*shifts)
    hrs = F.col("hora").between(float(hours[0]), float(hours[1]))
    work = ~weekday_index("data").isin(5, 6)
    scopes = {
        "all": F.lit(True),
        "shifts_ab": ab,
        "workdays": work,
        "shifts_ab_hours": ab & hrs,
        "workdays_ab_hours": work & ab & hrs,
    }
    aggs = []
    for i, cond in enumerate(scopes.values()):
        aggs += [
            F.count_if(cond).alias(f"n{i}"),
            F.avg(F.when(cond, F.col("oee"))).alias(f"o{i}"),
            F.avg(F.when(cond, F.col("teep"))).alias(f"t{i}"),
        ]
    rows = [(str(i), f"'{name}'", f"n{i}", f"o{i}", f"t{i}") for i, name in enumerate(scopes)]
    return _stack(facts.agg(*aggs), rows, ["scope_order", "scope", "n_rows", "oee_mean", "teep_mean"])


def dates_present(typed: DataFrame, period: tuple[str, str]) -> DataFrame:
    """Distinct dates of the sheet (all rows with a date) inside a period, with
    weekday names. Input: the typed sheet."""
    facts = typed.filter(in_period("data", period[0], period[1]))
    return (
        facts.select("data").distinct()
        .select("data", weekday_name("data").alias("weekday"), weekday_name_pt("data").alias("weekday_pt"))
        .orderBy("data")
    )
