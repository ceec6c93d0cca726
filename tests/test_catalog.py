"""Every query with a SQL twin gives the same rows; the others give some."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, name):
    problems, _ = compare(spark, con, queries()[name], oracle_sql()[name], SF)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, name):
    assert not queries()[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry(spark).count() > 0
