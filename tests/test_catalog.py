"""Every query with SQL against DuckDB over the same tables."""

import compare
import pytest

from orrery.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, con, name):
    assert compare.differences(catalog.queries()[name](spark, sf), con, catalog.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert sorted(catalog.queries()) == NAMES


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
