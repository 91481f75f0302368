import pytest
from conftest import in_order

from slidelake.plans import catalog_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog_queries.oracle_sql())
def test_query_equals_duckdb(spark, oracle, name):
    found = catalog_queries.queries()[name](spark, SF)
    assert in_order(found.columns, [tuple(r) for r in found.collect()]) == oracle(catalog_queries.oracle_sql()[name])


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog_queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
