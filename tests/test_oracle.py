"""Every registered query against its DuckDB oracle (sf0.001), plus the driver contract."""

import pytest

import __spark_entry__ as E
from plantwise.plans import catalog, oracle
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["n_rows", "teep_mean", "oee_mean"]
    assert df.count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare(df, duck_small, SQL.get(name)) == []
