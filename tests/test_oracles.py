"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["bigram", "n_train", "n_test", "difference"]
    assert frame.count() == 50
