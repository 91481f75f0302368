"""The queries that SQL can express: against DuckDB."""

import pytest
from conftest import in_order

from slidelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_duckdb(spark, oracle, name):
    found = queries.queries()[name](spark, SF)
    assert in_order(found.columns, [tuple(r) for r in found.collect()]) == oracle(queries.oracle_sql()[name])


def test_each_query_takes_session_and_folder():
    import inspect

    import __spark_entry__ as entry

    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in entry.queries().values())
    assert len(queries.queries()) == 13
