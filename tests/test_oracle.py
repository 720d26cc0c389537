"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from oracle import compare, tables

import __spark_entry__ as entry
from ringfold.plans import catalog


@pytest.fixture(scope="module")
def con(small_dir):
    return tables(small_dir)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, small_dir, name):
    assert compare(catalog.queries()[name](spark, small_dir), con, catalog.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
