import pytest
from oracle import DATA, both

from codekiln.plans import core_queries

QUERIES, SQL = core_queries.queries(), core_queries.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"rf_risk_fit"}))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
