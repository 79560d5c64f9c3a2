"""Every query equals its SQL twin on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, con, name):
    result = contract.queries()[name](spark, SF_DIR)
    names, rows = compare.spark_bag(result)
    assert rows
    if name in ORACLES:
        assert (names, rows) == compare.sql_bag(con, ORACLES[name])


def test_entry(spark):
    assert contract.entry(spark).count() == 1
