"""Append-only histories: read with tolerance, kept whole, shown by their tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.operators.profiling import history_tail

HISTORY_SCHEMA = "timestamp string, meanMs double, file string"
PROFILE_KEPT, TERMINAL_KEPT = 200, 500


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """ts, mean_ms, file, ordinal of a JSON array or JSON lines; rows without a time or a mean of at least 0 are dropped."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(HISTORY_SCHEMA).json(path)
    return tolerant(rows.select(F.col("timestamp").alias("ts"), F.col("meanMs").alias("mean_ms"), "file"))


def tolerant(rows: DataFrame) -> DataFrame:
    return rows.filter("ts is not null and ts <> '' and mean_ms >= 0 and not isnan(mean_ms)").withColumn("ordinal", F.monotonically_increasing_id())


def sort_time(ts: Column) -> Column:
    """A text as a time for sorting; what can't be read sorts as the start of 1970."""
    return F.coalesce(F.try_to_timestamp(ts), F.timestamp_seconds(F.lit(0)))


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def tail(history: DataFrame, keep: int = PROFILE_KEPT, keys: list[str] | None = None) -> DataFrame:
    """The latest rows, oldest first. The table itself is never rewritten."""
    sorted_rows = history.withColumn("sort_time", sort_time(F.col("ts")))
    return history_tail(sorted_rows, keys or [], ["sort_time", "ordinal"], keep).orderBy("sort_time", "ordinal").drop("sort_time")


def json_events(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """rows with the fields of a JSON text; null where it is none."""
    return rows.select("*", F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("parsed")).select("*", "parsed.*").drop("parsed")
