import pytest

from earshot.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], SQL[name]) > 0
