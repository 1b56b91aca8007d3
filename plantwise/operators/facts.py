"""Typed effectiveness facts from a positional sheet (S1 projection, C1-C9, F1-F6).

``oee_facts`` applies the filters in the order that is cheapest for Spark: every
predicate that is a function of (date, hour) or of the date alone is applied *before*
the activity filter (it commutes with it, SURVEY 4.1 law 1), so it also prunes the
slot aggregation branch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from plantwise.functions.cleaning import (
    day_first_date,
    hour_value,
    percent_fraction,
    shift_label,
    valid_machine,
    weekday_index,
    zero_as_null,
)

# Sheet positions of the fields that are read (0, 5, 6 are never read).
FACT_POSITIONS = {
    1: "maquina",
    2: "data",
    3: "turno",
    4: "hora",
    7: "disponibilidade",
    8: "performance",
    9: "qualidade",
    10: "teep",
    11: "oee",
}
PERCENT_COLUMNS = ("disponibilidade", "performance", "qualidade", "teep", "oee")
SHIFTS = ("Turno A", "Turno B")
WORK_HOURS = (6, 21)

DateLike = str | dt.date


def positional(raw: DataFrame, mapping: dict[int, str] | None = None, prefix: str = "c") -> DataFrame:
    """Pick sheet columns by position and name them."""
    mapping = mapping or FACT_POSITIONS
    return raw.select([F.col(f"{prefix}{i}").alias(name) for i, name in mapping.items()])


def typed_facts(
    raw: DataFrame,
    validate: bool = True,
    bad_percent_as_zero: bool = True,
    keep_raw_shift: bool = False,
    helpers: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Clean the positional sheet into typed rows.

    ``validate`` applies F1's machine test (F1' = ``validate=False`` keeps subtotal rows).
    Rows whose date text does not parse are always dropped. Columns ``carry`` go along.
    """
    named = raw.select(*(F.col(f"c{i}").alias(name) for i, name in FACT_POSITIONS.items()), *carry)
    if validate:
        named = named.filter(valid_machine("maquina"))
    cols: list[Column] = [
        F.col("maquina"),
        day_first_date("data").alias("data"),
        (F.col("turno") if keep_raw_shift else shift_label("turno")).alias("turno"),
        hour_value("hora").alias("hora"),
    ]
    cols += [percent_fraction(c, bad_percent_as_zero).alias(c) for c in PERCENT_COLUMNS]
    facts = named.select(*cols, *carry).filter(F.col("data").isNotNull())
    if helpers:
        facts = facts.withColumns(
            {"performance_nz": zero_as_null("performance"), "qualidade_nz": zero_as_null("qualidade")}
        )
    return facts


def in_period(date_col: Column | str, start: DateLike | None, end: DateLike | None,
              closed: str = "both") -> Column:
    """``[start, end]`` (closed='both'), ``[start, end)`` (closed='left');
    a missing end means open-ended (``date >= start``)."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= F.to_date(F.lit(str(start))))
    if end is not None:
        e = F.to_date(F.lit(str(end)))
        cond = cond & ((d <= e) if closed == "both" else (d < e))
    return cond


TYPED_COLUMNS = ("maquina", "data", "turno", "hora", *PERCENT_COLUMNS, "machine_ok")


def typed_sheet(raw: DataFrame) -> DataFrame:
    """All rows of the sheet with a parseable date, cleaned, plus the F1 machine test as
    a flag (``machine_ok``) so that validated and unvalidated populations come from one
    table. This is what ``stage_typed_sheet`` writes once."""
    named = positional(raw)
    cols = [F.col("maquina"), day_first_date("data").alias("data"), shift_label("turno").alias("turno"),
            hour_value("hora").alias("hora")]
    cols += [percent_fraction(c, True).alias(c) for c in PERCENT_COLUMNS]
    cols += [valid_machine("maquina").alias("machine_ok")]
    return named.select(*cols).filter(F.col("data").isNotNull())


def filter_facts(
    typed: DataFrame,
    period: tuple[DateLike | None, DateLike | None] | None = None,
    shifts: tuple[str, ...] | None = SHIFTS,
    hours: tuple[float, float] | None = WORK_HOURS,
    weekdays_below: int | None = None,
    validate: bool = True,
    closed: str = "both",
) -> DataFrame:
    """F1-F6 on an already typed table (see ``typed_sheet``): every predicate is on a
    typed column, so the period prunes date partitions and the rest is pushed to the
    scan."""
    facts = typed
    if validate:
        facts = facts.filter(F.col("machine_ok"))
    if period is not None:
        facts = facts.filter(in_period("data", period[0], period[1], closed))
    if weekdays_below is not None:
        facts = facts.filter(weekday_index("data") < weekdays_below)
    if shifts:
        facts = facts.filter(F.col("turno").isin(*shifts))
    if hours is not None:
        facts = facts.filter(F.col("hora").between(float(hours[0]), float(hours[1])))
    return facts.drop("machine_ok")


def oee_facts(
    raw: DataFrame,
    period: tuple[DateLike | None, DateLike | None] | None = None,
    shifts: tuple[str, ...] | None = SHIFTS,
    hours: tuple[float, float] | None = WORK_HOURS,
    weekdays_below: int | None = None,
    validate: bool = True,
    bad_percent_as_zero: bool = True,
    closed: str = "both",
    helpers: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """F1-F6 over the typed sheet: valid rows, shift in ``shifts``, ``hours`` window
    (inclusive), weekday index below ``weekdays_below`` (5 = Mon-Fri, 6 = Mon-Sat),
    ``period`` on the date."""
    facts = typed_facts(raw, validate=validate, bad_percent_as_zero=bad_percent_as_zero, helpers=helpers, carry=carry)
    if period is not None:
        facts = facts.filter(in_period("data", period[0], period[1], closed))
    if weekdays_below is not None:
        facts = facts.filter(weekday_index("data") < weekdays_below)
    if shifts:
        facts = facts.filter(F.col("turno").isin(*shifts))
    if hours is not None:
        facts = facts.filter(F.col("hora").between(float(hours[0]), float(hours[1])))
    return facts
