"""Every registered query against its DuckDB text on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
import test_chains  # noqa: E402
import test_forest  # noqa: E402
import test_golden  # noqa: E402
import test_scoring  # noqa: E402
from caretrace.plans.registry import QUERIES  # noqa: E402
from oracle import VALUE_TESTS, compare, duck  # noqa: E402

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    ok, note = compare(spark, con, key, entry.queries()[key], entry.oracle_sql().get(key), SF_DIR)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_named_value_tests_exist():
    assert all(any(hasattr(m, name) for m in (test_golden, test_scoring, test_forest, test_chains)) for name in VALUE_TESTS.values())
    assert set(VALUE_TESTS) <= set(QUERIES) - set(entry.oracle_sql())
