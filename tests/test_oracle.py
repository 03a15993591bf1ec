"""Every registered report against its SQL twin on the whole test tables."""

import pytest

import __spark_entry__ as entry_points
from oracle.compare import differences, open_tables
from oracle.statements import oracle_statements
from wardlight.plans.registry import registered_queries

NAMES = sorted(registered_queries())


@pytest.fixture(scope="module")
def tables(medium):
    return open_tables(medium)


def test_every_report_has_a_twin():
    assert set(registered_queries()) == set(oracle_statements())
    assert set(registered_queries()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, medium, tables, name):
    result = entry_points.queries()[name](spark, medium)
    assert result.columns
    assert differences(result, tables, entry_points.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
