import pytest

from tessellar.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(same, name):
    same(QUERIES[name], SQL[name])


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
