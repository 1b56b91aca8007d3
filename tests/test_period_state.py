"""Means of any period from the slot state (A1-A3, R6) against the facts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plantwise.operators import activity as act
from plantwise.operators import facts as fx
from plantwise.operators import reconcile as rc
from plantwise.operators.period_state import PeriodState
from plantwise.streaming.ingest import slot_sums

BASE = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def state(spark):
    rnd = random.Random(1)
    rows = []
    for day in [0, 1, 2, 5, 6, 7, 11, 12, 13, 20, 29, 33]:  # gaps of whole days
        for hour in (6.0, 7.0, 8.0):
            idle = rnd.random() < 0.3
            for turno in ("Turno A", "Turno B"):
                for m in range(rnd.randrange(3)):
                    rows.append((f"m{m}", BASE + dt.timedelta(days=day), turno, hour, 0.0 if idle else rnd.random(), rnd.random()))
    facts = spark.createDataFrame(rows, "maquina string, data date, turno string, hora double, oee double, teep double").cache()
    yield facts, PeriodState.build(slot_sums(facts))
    facts.unpersist()


def near(a, b):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b]


PERIODS = [(0, 33), (-10, 100), (3, 4), (2, 11), (5, 5), (33, 40), (50, 60), (-9, -1), (12, 7)]


@pytest.mark.parametrize("lo, hi", PERIODS)
@pytest.mark.parametrize("below, closed", [(None, "both"), (5, "left"), (6, "both")])
def test_any_period_equals_the_facts(state, lo, hi, below, closed):
    facts, s = state
    a, b = (str(BASE + dt.timedelta(days=d)) for d in (lo, hi))
    own = facts.where(fx.in_period("data", a, b, closed))
    if below is not None:
        own = own.where(F.weekday("data") < below)
    order = ["turno"]
    assert near(s.means(a, b, closed, ("turno",), below).orderBy(*order).collect(), act.active_means(own, ("turno",)).orderBy(*order).collect())
    order = ["data", "turno"]
    assert near(s.day_means(a, b, closed, below).orderBy(*order).collect(), act.active_means(own, ("data", "turno")).orderBy(*order).collect())
    whole = act.active_means(own).first()
    got = s.means(a, b, closed, (), below).first()
    assert (got.n_rows, round(got.teep_mean or 0, 9)) == (whole.n_rows or 0, round(whole.teep_mean or 0, 9))


def test_many_periods_at_once(state):
    facts, s = state
    day = lambda d: str(BASE + dt.timedelta(days=d))
    periods = {f"p{i}": (day(lo), day(hi), "left" if i % 2 else "both") for i, (lo, hi) in enumerate(PERIODS)}
    assert near(s.period_means(periods).orderBy("period_order").collect(), rc.period_sensitivity(facts, periods).orderBy("period_order").collect())


def test_open_ended_and_empty(spark, state):
    facts, s = state
    assert s.means().first().n_rows == act.active_means(facts).first().n_rows
    empty = PeriodState.build(slot_sums(facts.limit(0)))
    assert empty.means("2024-01-01", "2024-02-01").first().n_rows == 0
    assert empty.day_means("2024-01-01", None).count() == 0


def test_a_period_reads_two_days_of_the_calendar(state):
    _, s = state
    plan = s.means("2024-01-03", "2024-01-13")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(day" in plan and plan.count("FileScan") == 1 and "Window" not in plan and "Join" not in plan
