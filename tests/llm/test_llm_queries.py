import pytest
from sqlcheck import same, views

from strandloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, data, name):
    same(spark, con, queries()[name], oracle_sql()[name], data)


def test_each_problem_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 11))
