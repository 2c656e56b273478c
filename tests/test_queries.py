"""Registered queries against their SQL at the smallest scale; ``tools/compare.py`` runs them at any scale."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from compare import compare, connect
from rowwarden.workload.base import ORACLES, QUERIES

SF_DIR = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF_DIR}/*.parquet"), reason="no test data")


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    verdict, _, _ = compare(spark, database, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict == "ok"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["ordinal", "check_id", "table"] and result.count() == 27
