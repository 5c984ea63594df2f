"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, query, sql, folder=DATA):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(repr(plain(tuple(r))) for r in df.select(columns).collect())
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(plain(tuple(r[k] for k in order))) for r in found.fetchall())
    return ours, theirs
