import pytest

from dispatchline import queries

from .conftest import SMALL

SLOW = {"oof_scores"}  # five fits; tests of the model fit folds on small rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - SLOW))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_needs_no_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())
