"""Every query of the subpackage runs; those with a SQL twin give the rows that DuckDB gives."""

import pytest

from tests.twins import assert_twin
from tidewell.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(name, spark, data):
    sql = q.oracle_sql().get(name)
    if sql:
        assert_twin(q.queries()[name], sql, spark, data)
    else:
        assert q.queries()[name](spark, data).count() >= 0
