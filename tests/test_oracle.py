"""Every registered query with SQL is compared with DuckDB; the others must run."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from checks.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
