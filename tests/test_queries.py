import pytest
from conftest import compare

from gleanery.plans import documents, evidence, pipeline, registry, reports, streams  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    compare(duck, registry.QUERIES[name](spark, sf), registry.SQL[name])


def test_every_query_is_stated_as_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["entity_id", "rank", "result_id", "score"]
