"""Queries that SQL can express, against DuckDB."""

import compare
import pytest

from orrery.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert compare.differences(registry.queries()[name](spark, sf), compare.connect(sf), registry.oracle_sql()[name]) == ""


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())
