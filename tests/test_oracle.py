"""Every SQL-checkable query against DuckDB on the smallest tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "alpha" in df.columns
