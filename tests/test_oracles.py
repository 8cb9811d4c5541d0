"""Every registered query of the library against its DuckDB oracle."""

import pytest

from sparklake import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert oracle.spark_types(df) == oracle.duckdb_types(con, SQL[name])
    assert oracle.spark_rows(df) == oracle.duckdb_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
