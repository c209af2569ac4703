"""Registered queries against DuckDB on the same tables.

All queries that SQL can say are compared when ``ORACLE=all``; a spread of them otherwise.
The complete comparison is also ``python -m workload.check <sf_dir>``.
"""

import os

import pytest

from conftest import SF_DIR
from workload.catalog import REGISTRY
from workload.check import compare, duck
from workload.registry import runner

CHECKED = [n for n, q in REGISTRY.items() if q.sql]
SPREAD = CHECKED if os.environ.get("ORACLE") == "all" else CHECKED[::9]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", SPREAD)
def test_same_rows(spark, con, name):
    result, _ = compare(runner(REGISTRY[name])(spark, SF_DIR), con, REGISTRY[name].sql)
    assert result == "ok"


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
