"""Reconciliation of computed means against published targets.

Every report is one scan of the facts: sums and counts per slot, activity flags on that small
table, and conditional sums of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantwise.functions.cleaning import SCHEDULED_HOURS, TOTAL_HOURS, weekday_index
from plantwise.operators.activity import slot_state
from plantwise.operators.facts import in_period
from plantwise.operators.measures import _stack

# Tolerance bands (percentage points) and their labels.
BANDS_FINAL = [(0.5, "PERFEITO"), (1.0, "EXCELENTE"), (2.0, "MUITO BOM")]
BANDS_FINAL_ELSE = "ACEITAVEL"
BANDS_SHORT = [(0.5, "PERFEITO"), (1.5, "MUITO BOM")]
BANDS_SHORT_ELSE = "DIFERENCA"
PASS_LIMIT = 1.0
PASS_LABELS = ("OK", "ATENCAO")
MATCH_LIMIT = 0.5
MARK_LIMIT = 0.5
MARK = "<<<"


def distance_points(value: Column, target: Column | float) -> Column:
    """abs(target - value) in percentage points (values are fractions)."""
    t = target if isinstance(target, Column) else F.lit(float(target))
    return F.abs(t * 100.0 - value * 100.0)


def band(diff_points: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Chained ``<`` thresholds, first match wins."""
    out = None
    for limit, label in bands:
        cond = diff_points < F.lit(float(limit))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def _mean(total: str, n: str, cond: Column | None = None) -> Column:
    """Mean of rows from slot sums, over the slots where ``cond`` holds (null without rows)."""
    if cond is None:
        return F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    return F.sum(F.when(cond, F.col(total))) / F.nullif(F.sum(F.when(cond, F.col(n))), F.lit(0))


def _rows(n: str, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("bigint")


def method_comparison(facts: DataFrame, target: float) -> DataFrame:
    """Five means of TEEP with their distance to the target.

    simple | active slots | TEEP > 0 | mean of daily means (active rows) | mean of
    machine means (active rows).
    """
    teep = F.col("teep")
    state = slot_state(facts, {"n": F.lit(1), "teep": teep, "n_pos": (teep > 0).cast("int"), "pos": F.when(teep > 0, teep)}, ("maquina",))
    act = F.col("act_global")
    # grouping sets (), (date), (machine) over the slot sums
    sets = state.groupingSets([[], ["data"], ["maquina"]], "data", "maquina").agg(
        F.grouping_id().alias("_gid"),
        _mean("teep", "n").alias("_all"),
        _mean("teep", "n", act).alias("_act"),
        _mean("pos", "n_pos").alias("_pos"),
    )
    # grouping_id bits follow the grouping columns (data, maquina): () = 3, (data) = 1, (maquina) = 2
    gid = F.col("_gid")
    wide = sets.agg(
        F.max(F.when(gid == 3, F.col("_all"))).alias("m1"),
        F.max(F.when(gid == 3, F.col("_act"))).alias("m2"),
        F.max(F.when(gid == 3, F.col("_pos"))).alias("m3"),
        F.avg(F.when(gid == 1, F.col("_act"))).alias("m4"),
        F.avg(F.when(gid == 2, F.col("_act"))).alias("m5"),
    )
    rows = _stack(wide, [("1", "'simple'", "m1"), ("2", "'active_slots'", "m2"), ("3", "'teep_positive'", "m3"),
                         ("4", "'daily_means'", "m4"), ("5", "'machine_means'", "m5")],
                  ["method_order", "method", "teep"])
    return rows.withColumn("diff_points", distance_points(F.col("teep"), target))


def closest_method(methods: DataFrame) -> DataFrame:
    """The method with the smallest distance; ties go to the first listed."""
    best = F.min_by(F.struct("method_order", "method", "teep", "diff_points"), F.struct("diff_points", "method_order"))
    return methods.agg(best.alias("b")).select("b.method_order", "b.method", "b.teep", "b.diff_points")


def daytype_activity_grid(facts: DataFrame, target: float) -> DataFrame:
    """R2: {all days, Mon-Fri, Mon-Sat} x {active slots, unfiltered} mean TEEP.

    Date-only predicates do not change a slot's sum, so one activity flag serves all six
    cells; the grid is one conditional aggregate."""
    state = slot_state(facts, {"n": F.lit(1), "teep": F.col("teep")})
    wd = weekday_index("data")
    day_types = {"all": F.lit(True), "mon_fri": wd < 5, "mon_sat": wd < 6}
    cells = []
    for dname, dcond in day_types.items():
        for aname, acond in (("active", F.col("act_global")), ("unfiltered", F.lit(True))):
            cells.append((dname, aname, dcond & acond))
    aggs = []
    for i, (_, _, cond) in enumerate(cells):
        aggs += [_rows("n", cond).alias(f"n{i}"), _mean("teep", "n", cond).alias(f"t{i}")]
    rows = [(str(i + 1), f"'{d}'", f"'{a}'", f"n{i}", f"t{i}") for i, (d, a, _) in enumerate(cells)]
    grid = _stack(state.agg(*aggs), rows, ["cell_order", "day_type", "activity", "n_rows", "teep_mean"])
    diff = distance_points(F.col("teep_mean"), target)
    return grid.withColumns(
        {"diff_points": diff, "mark": F.when(diff < F.lit(MARK_LIMIT), F.lit(MARK)).otherwise(F.lit(""))}
    )


def activity_mode_fit(facts: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Mean TEEP per shift under three activity modes (per-shift slots, global
    slots, none), each shift's distance to its own target, the summed distance per mode
    and the best mode (smallest sum)."""
    state = slot_state(facts, {"n": F.lit(1), "teep": F.col("teep")})
    modes = {"shift": F.col("act_shift"), "global": F.col("act_global"), "none": F.lit(True)}
    aggs = []
    for i, cond in enumerate(modes.values()):
        aggs += [_rows("n", cond).alias(f"n{i}"), _mean("teep", "n", cond).alias(f"t{i}")]
    per_shift = state.groupBy("turno").agg(*aggs)
    rows = [(str(i + 1), f"'{m}'", f"n{i}", f"t{i}") for i, m in enumerate(modes)]
    long = per_shift.selectExpr("turno", f"stack({len(rows)}, {', '.join(', '.join(r) for r in rows)}) as (mode_order, mode, n_rows, teep_mean)")
    target_map = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])
    long = long.withColumn("target", F.element_at(target_map, F.col("turno")))
    long = long.withColumn("diff_points", distance_points(F.col("teep_mean"), F.col("target")))
    # windows over one row per shift and mode
    total = F.sum("diff_points").over(Window.partitionBy("mode_order", "mode"))
    out = long.withColumn("mode_total_diff", total)
    best = F.min(F.struct("mode_total_diff", "mode_order")).over(Window.partitionBy())
    return out.withColumn("is_best", F.col("mode_order") == best["mode_order"])


def tolerance_bands(values: DataFrame, value_col: str, target: Column | float,
                    previous_gap_points: float | None = None) -> DataFrame:
    """R5 + R7: distance in points and the four band variants; improvement over a
    previous gap when one is given."""
    diff = distance_points(F.col(value_col), target)
    out = values.withColumns(
        {
            "diff_points": diff,
            "band_final": band(diff, BANDS_FINAL, BANDS_FINAL_ELSE),
            "band_short": band(diff, BANDS_SHORT, BANDS_SHORT_ELSE),
            "pass_fail": F.when(diff < F.lit(PASS_LIMIT), F.lit(PASS_LABELS[0])).otherwise(F.lit(PASS_LABELS[1])),
        }
    )
    if previous_gap_points is not None:
        out = out.withColumn("improvement_points", F.lit(float(previous_gap_points)) - F.col("diff_points"))
    return out


def first_match(first: Column, second: Column, target: float, names: tuple[str, str, str]) -> Column:
    """R5 variant 3: which of two methods is within MATCH_LIMIT points first."""
    return (
        F.when(distance_points(first, target) < MATCH_LIMIT, F.lit(names[0]))
        .when(distance_points(second, target) < MATCH_LIMIT, F.lit(names[1]))
        .otherwise(F.lit(names[2]))
    )


def period_sensitivity(facts: DataFrame, periods: dict[str, tuple[str, str, str]]) -> DataFrame:
    """TEEP over several period definitions ``name -> (start, end, closed)`` with the
    first and last date present (before the activity filter). One scan with one
    activity flag (date predicates commute with slot activity)."""
    state = slot_state(facts, {"n": F.lit(1), "teep": F.col("teep")})
    aggs = []
    for i, (start, end, closed) in enumerate(periods.values()):
        inp = in_period("data", start, end, closed)
        aggs += [
            _rows("n", inp & F.col("act_global")).alias(f"n{i}"),
            _mean("teep", "n", inp & F.col("act_global")).alias(f"t{i}"),
            F.min(F.when(inp, F.col("data"))).alias(f"f{i}"),
            F.max(F.when(inp, F.col("data"))).alias(f"l{i}"),
        ]
    rows = [(str(i + 1), f"'{name}'", f"n{i}", f"t{i}", f"f{i}", f"l{i}") for i, name in enumerate(periods)]
    return _stack(state.agg(*aggs), rows, ["period_order", "period", "n_rows", "teep_mean", "first_date", "last_date"])


def teep_formula_variants(facts: DataFrame, target_teep: float, scheduled: float = SCHEDULED_HOURS,
                          total: float = TOTAL_HOURS) -> DataFrame:
    """R8 + R9: the sheet's TEEP column, mean(OEE) x 16/24, mean of per-row OEE x 16/24,
    mean(OEE over active slots) x 16/24, and the OEE a target TEEP implies."""
    factor = F.lit(float(scheduled)) / F.lit(float(total))
    act = F.col("act_global")
    agg = slot_state(facts, {"n": F.lit(1), "teep": F.col("teep"), "oee": F.col("oee")}).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        _rows("n", act).alias("n_active"),
        _mean("teep", "n").alias("teep_file"),
        _mean("oee", "n").alias("oee_mean"),
        (_mean("oee", "n") * factor).alias("teep_per_row"),
        _mean("oee", "n", act).alias("oee_active_mean"),
    )
    return agg.select(
        "*",
        (F.col("oee_mean") * factor).alias("teep_from_mean_oee"),
        (F.col("oee_active_mean") * factor).alias("teep_active"),
        (F.lit(float(target_teep)) / factor).alias("implied_oee"),
    )


def positive_only_means(facts: DataFrame, scheduled: float = SCHEDULED_HOURS, total: float = TOTAL_HOURS) -> DataFrame:
    """F10 + R10: means restricted to positive TEEP / OEE / availability."""
    factor = F.lit(float(scheduled)) / F.lit(float(total))
    return facts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("oee").alias("oee_mean"),
        F.avg(F.when(F.col("oee") > 0, F.col("oee"))).alias("oee_positive_mean"),
        F.count_if(F.col("oee") > 0).alias("n_oee_positive"),
        F.avg(F.when(F.col("disponibilidade") > 0, F.col("oee"))).alias("oee_mean_avail_positive"),
        F.avg(F.when(F.col("teep") > 0, F.col("teep"))).alias("teep_positive_mean"),
    ).withColumn("teep_nonzero", F.col("oee_positive_mean") * factor)
