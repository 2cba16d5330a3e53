import pytest

from quire.plans import declared_queries, document_queries, relational_queries

MODULES = {name: m for m in (relational_queries, document_queries, declared_queries) for name in m.queries()}


@pytest.mark.parametrize("name", sorted(MODULES))
def test_query_matches_its_sql(name, spark, sf, duck, same):
    module = MODULES[name]
    got = module.queries()[name](spark, sf).toPandas()
    if name in module.oracle_sql():
        same(got, duck.execute(module.oracle_sql()[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
