"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, sf, name):
    plan, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert plan(spark, sf).count() > 0
    else:
        assert compare(spark, con, sf, plan, sql) is None


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
