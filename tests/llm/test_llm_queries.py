import pytest

from dispatchline.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_the_driver_sees_them():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
