"""Every driver query against its SQL counterpart."""

import os

import compare
import pytest

import __spark_entry__ as driver
from paperloom.plans import catalog

FOLDER = os.environ.get("PAPERLOOM_TEST_DATA", "/root/testdata/sf0.01")
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_of_the_library_has_sql():
    assert set(catalog.QUERIES) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["year", "llm", "non_llm", "llm_pct"]
    assert result.count() > 0
