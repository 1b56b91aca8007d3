"""Plan shape: no Python in the hot path, no cross products, no single-partition exchanges
where the data grows, one scan of the facts for every report, and nothing persisted."""

import pytest

from plantwise.plans import catalog
from tests.conftest import SF_SMALL

QUERIES = catalog.queries()
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# order of lines inside a split is the one thing read by an Arrow function
BY_SPLIT = ("record_scan_split", "source_profile")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") and n not in BY_SPLIT))
def test_no_python_and_no_cartesian(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert not any(node in plan for node in PY_NODES), name
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["active_hours_one_day", "active_rows_global", "active_rows_shift"])
def test_active_rows_are_a_semi_join(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "LeftSemi" in plan and "InMemoryTableScan" not in plan


def test_flagship_reads_facts_once_without_a_join(spark):
    plan = plan_text(QUERIES["oee_overall"](spark, SF_SMALL))
    assert sum(1 for line in plan.split("\n") if "FileScan" in line) == 1
    assert "Join" not in plan


def test_period_prunes_date_partitions(spark):
    df = QUERIES["oee_by_shift"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data" in plan


@pytest.mark.parametrize("name", ["fx_asof", "context_by_group", "substring_all_columns", "money_by_group",
                                  "active_slots_global", "active_slots_shift", "oee_by_day_shift"])
def test_no_single_partition_exchange(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "SinglePartition" not in plan, name


def test_context_moves_no_text_before_its_lines_are_chosen(spark):
    plan = plan_text(QUERIES["context_by_group"](spark, SF_SMALL))
    joined = plan[plan.index("Join"):]
    # the texts that meet the chosen lines are cut to the budget, and only there do they move
    assert "substring(" in joined and "context-sizes" in joined


REPORTS = ["method_comparison", "closest_method", "daytype_activity_grid", "activity_mode_fit", "period_sensitivity",
           "teep_formula_variants", "filter_funnel", "mean_of_daily", "mean_of_machine", "weighted_daily", "tolerance_bands"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_scan_the_facts_once(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert sum(1 for line in plan.split("\n") if "FileScan" in line) == 1
    assert "Join" not in plan and "InMemoryTableScan" not in plan
