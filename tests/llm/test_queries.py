import pytest
from oracle import DATA, both

from codekiln.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_found_columns(spark):
    expected = {
        "p1_found": [("pair_id", "bigint"), ("field_name", "string")],
        "p3_found": [("pair_id", "bigint"), ("field_name", "string")],
        "p4_found": [("pair_id", "bigint"), ("defect", "string")],
        "p5_found": [("pair_id_1", "bigint"), ("pair_id_2", "bigint")],
        "p6_found": [("pair_id_1", "bigint"), ("pair_id_2", "bigint")],
        "p7_found": [("line_id_1", "bigint"), ("line_id_2", "bigint")],
        "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p10_found": [("doc_id", "bigint"), ("start_at", "int"), ("end_at", "int")],
    }
    for name, columns in expected.items():
        assert QUERIES[name](spark, DATA).dtypes == columns
