"""Every query with checking SQL gives the same types, rows and values as the SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SQL = oracle_sql()
# Whole runs and searches on default settings take one to three minutes each: with SLOW_QUERIES=1, or by oracle_check.py.
SLOW = {"full_run", "inference_run", "owner_run", "model_selection", "random_forest_search", "boosted_a_search"}


@pytest.fixture(scope="module")
def duck():
    return connect("0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf01, duck):
    if name in SLOW and not os.environ.get("SLOW_QUERIES"):
        pytest.skip("a slow query")
    got = queries()[name](spark, sf01).toArrow()
    assert got.num_rows > 0
    assert compare(got, duck.execute(SQL[name]).to_arrow_table()) == []


def test_entry(spark):
    out = entry(spark)
    assert out.count() > 0 and "anomaly_zscore" in out.columns


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())
