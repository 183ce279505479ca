"""Every registered query against DuckDB on the smallest tables."""

import pytest
from tests.compare import SMALL, connection, same

from glyphmill.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same(registry.queries()[name](spark, SMALL), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    out = registry.queries()[name](spark, SMALL)
    assert out.columns and out.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
