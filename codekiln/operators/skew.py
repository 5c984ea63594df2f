"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread_by: str | None, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined to few, which has a small number of rows for each key.

    rows of one key go to as many as `salts` tasks, by the hash of their column
    spread_by, or of all columns; few is repeated once for each salt. Nulls in keys match nothing.
    `how` is inner or left.
    """
    salt = "__salt"
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(*([spread_by] if spread_by else rows.columns)), F.lit(salts)).cast("int"))
    repeated = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, salt], how).drop(salt)
