"""Queries that SQL can express, against DuckDB at the smallest size."""

import pytest

from plantwise.llm import oracle, queries
from tests.conftest import SF_SMALL
from tools.oracle_check import compare


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, duck_small, name):
    assert compare(queries.queries()[name](spark, SF_SMALL), duck_small, oracle.oracle_sql()[name]) == []


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, len(queries.queries()) + 1))
