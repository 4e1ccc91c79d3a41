"""Every registered query runs; those with an SQL twin give exactly its rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def sql(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sql, folder, name):
    difference = compare(QUERIES[name](spark, folder).toPandas(), sql.sql(ORACLES[name]).df())
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
