"""Queries of the training-data operators against their SQL twins, on the smallest tables."""

import pytest
from oracle import compare, tables

from ringfold.llm import queries as Q


@pytest.fixture(scope="module")
def con(small_dir):
    return tables(small_dir)


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, small_dir, name):
    assert compare(Q.queries()[name](spark, small_dir), con, Q.oracle_sql()[name]) is None
