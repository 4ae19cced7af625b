"""Every credit query with an SQL form equals it on the small tables."""

import pytest

from quillon.plans.queries import QUERIES
from quillon.plans.sql import SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, oracle, name):
    assert same(QUERIES[name](spark, small), oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
