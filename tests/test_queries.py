import pytest
from sqlcheck import same, views

from strandloom.plans.oracle import oracle_sql
from strandloom.plans.queries import queries


@pytest.fixture(scope="module")
def con(data):
    return views(data)


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, data, name):
    same(spark, con, queries()[name], oracle_sql()[name], data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src", "dst"]
    assert set(queries()) <= set(__spark_entry__.queries())
