"""Every registered query with an SQL twin, compared value by value on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog.check import close_differences, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert close_differences(ours, con.sql(entry.oracle_sql()[name]).df()) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
