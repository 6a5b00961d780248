"""Every registered query gives the rows of its SQL."""

import os

import pytest
from check_oracle import compare, duck

from __spark_entry__ import entry
from catalog import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert compare(con, df, SQL[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
