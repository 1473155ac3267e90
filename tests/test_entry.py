"""Every query against its check SQL, and the model queries for shape, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.check import compare, duck

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_check_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note
