import pytest

from tessellar.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(same, name):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_a_twin_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
