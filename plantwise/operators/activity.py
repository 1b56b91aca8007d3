"""Active-slot filters.

A slot is (date, hour) -- or (date, shift, hour) per shift -- and it is active when the
summed OEE of its rows is > 0. Figures over active slots come from ``slot_state``: one scan,
aggregated (partially, map-side) to sums and counts per slot, with activity decided by
windows over that small table. Only where the active rows themselves are the output
(``keep_active``) are the facts joined with the slot table, by a plain semi join whose kind
adaptive execution chooses by the table's measured size. Nothing is persisted and no job runs
while a query is built, so results always reflect the files as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOT_KEYS = {"global": ("data", "hora"), "shift": ("data", "turno", "hora")}
# Fixed labels of the slot activity table.
ACTIVE_LABEL = "ATIVA"
INACTIVE_LABEL = "INATIVA"


def slot_totals(facts: DataFrame, keys: tuple[str, ...] = SLOT_KEYS["global"], measure: str = "oee") -> DataFrame:
    """Sum of ``measure`` and row count per slot."""
    return facts.groupBy(*keys).agg(F.sum(measure).alias("oee_total"), F.count(F.lit(1)).alias("n_rows"))


def active_slots(facts: DataFrame, mode: str = "global", measure: str = "oee") -> DataFrame:
    keys = SLOT_KEYS[mode]
    return slot_totals(facts, keys, measure).filter(F.col("oee_total") > 0).select(*keys)


def keep_active(facts: DataFrame, mode: str = "global", measure: str = "oee") -> DataFrame:
    """F7 (mode='global') / F8 (mode='shift'); mode='none' returns the input."""
    if mode == "none":
        return facts
    return facts.join(active_slots(facts, mode, measure), list(SLOT_KEYS[mode]), "left_semi")


def slot_state(facts: DataFrame, sums: dict[str, Column], by: tuple[str, ...] = (), measure: str = "oee",
               counted: Column | None = None) -> DataFrame:
    """Sums per (date, hour, shift) and ``by``, with ``act_global`` and ``act_shift``: whether the
    slot's total of ``measure`` -- of the rows where ``counted`` holds, if given -- is > 0."""
    keys = list(dict.fromkeys([*SLOT_KEYS["shift"], *by]))
    total = F.col(measure) if counted is None else F.when(counted, F.col(measure))
    state = facts.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.sum(total).alias("_slot"))

    def active(mode: str) -> Column:
        return F.coalesce(F.sum("_slot").over(Window.partitionBy(*SLOT_KEYS[mode])) > 0, F.lit(False))

    return state.withColumns({"act_global": active("global"), "act_shift": active("shift")}).drop("_slot")


def active_hours_one_day(facts: DataFrame, day: str, measure: str = "oee") -> DataFrame:
    """rows of one day whose hour has summed OEE > 0 on that day."""
    one_day = facts.filter(F.col("data") == F.to_date(F.lit(day)))
    return keep_active(one_day, "global", measure)


def slot_activity(facts: DataFrame, keys: tuple[str, ...] = SLOT_KEYS["global"], measure: str = "oee") -> DataFrame:
    """Summed OEE per slot with an ATIVA/INATIVA label."""
    return slot_totals(facts, keys, measure).select(
        *keys,
        "oee_total",
        F.when(F.col("oee_total") > 0, F.lit(ACTIVE_LABEL)).otherwise(F.lit(INACTIVE_LABEL)).alias("status"),
    )


def active_means(
    facts: DataFrame,
    by: tuple[str, ...] = (),
    mode: str = "global",
    measures: tuple[str, ...] = ("teep", "oee"),
    measure: str = "oee",
    with_total: bool = False,
) -> DataFrame:
    """F7/F8 + A1-A3 in one scan: means over active-slot rows without filtering rows.

    The facts are aggregated (partially, map-side) to (slot keys + ``by``) sums and
    counts; a slot's activity is a window sum over that small table; the means are
    sum / count over active slots. No fact row is joined or moved, no size check is
    needed, and a hot slot is one row. With a single ``by`` key, ``with_total`` adds the
    overall row (key labelled 'all') through grouping sets. Use ``keep_active`` when the
    active rows themselves are the output.
    """
    slot = SLOT_KEYS[mode]
    keys = list(dict.fromkeys([*slot, "turno", *by]))
    sums = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(m).alias(f"_s_{m}") for m in dict.fromkeys([*measures, measure])],
    )
    slot_total = F.sum(f"_s_{measure}").over(Window.partitionBy(*slot))
    active = sums.withColumn("_slot", slot_total).filter(F.col("_slot") > 0)
    aggs = [F.sum("_n").alias("n_rows"),
            *[(F.sum(f"_s_{m}") / F.sum("_n")).alias(f"{m}_mean") for m in measures]]
    if with_total and len(by) == 1:
        key = by[0]
        sets = active.groupingSets([[key], []], key).agg(F.grouping_id().alias("_gid"), *aggs)
        label = F.when(F.col("_gid") == 0, F.col(key).cast("string")).otherwise(F.lit("all"))
        return sets.select(label.alias(key), "n_rows", *[f"{m}_mean" for m in measures])
    return active.groupBy(*by).agg(*aggs)
