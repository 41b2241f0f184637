"""Every core query with a SQL twin gives the rows that DuckDB gives."""

from importlib import import_module

import pytest

from tests.twins import assert_twin

MODULES = [import_module(f"tidewell.plans.{m}") for m in ("preparation", "lake", "panels", "benchmark", "texts")]
QUERIES = {n: q for m in MODULES for n, q in m.queries().items()}
SQL = {n: q for m in MODULES for n, q in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, data):
    assert_twin(QUERIES[name], SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).columns
