"""Streams of compiler output, edits and timed runs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codekiln.operators.diagnostics import parse_log

LOG_SCHEMA = "file_id string, compiler string, chunk_no long, stderr string, logged_at timestamp"
EDIT_SCHEMA = "path string, seq long, content string"
RUN_SCHEMA = "run_target string, duration_ms double, ts timestamp"


def diagnostics_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and warnings of compiler output as it arrives, as JSON lines in a folder."""
    logs = spark.readStream.schema(LOG_SCHEMA).json(folder)
    return parse_log(logs, "stderr", ["file_id", "compiler", "chunk_no"])


def unmapped_messages(messages: DataFrame, patterns: list[str]) -> DataFrame:
    """Messages that no pattern fits, for a sink of their own."""
    return messages.filter(~F.coalesce(F.lower("message").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))) if patterns else messages


def stage_edits(edits: DataFrame, target: str, checkpoint: str, every: str = "30 seconds", once: bool = False, compact_every: int = 50) -> StreamingQuery:
    """Keeps the last content of each path in a table at target: a batch adds what it changed, and every compact_every batches all is written anew.

    A batch that is run again writes the same folder, so nothing is lost or doubled.
    staged() reads the last whole table and the changes behind it; what both have
    made needless goes one compaction later, so that readers at work keep their files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _last(batch).write.mode("overwrite").parquet(_part(target, "changes", number))
        if (number + 1) % compact_every == 0:
            staged(spark, target, upto=number).write.mode("overwrite").parquet(_part(target, "whole", number))
            _forget(spark, target, number - compact_every)

    stream = edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=every)).start()


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("content", "seq").alias("content"))


def _part(target: str, kind: str, number: int) -> str:
    return os.path.join(target, kind, f"batch={number:012d}")


def _written(spark: SparkSession, target: str, kind: str) -> list[tuple[int, str]]:
    """(batch, path) of the folders of a kind that were written to their end, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target, kind)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((int(p.rsplit("=", 1)[1]), p) for p in done)


def _forget(spark: SparkSession, target: str, number: int) -> None:
    """Deletes changes up to the batch and whole tables before it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for batch, path in [x for x in _written(spark, target, "changes") if x[0] <= number] + [x for x in _written(spark, target, "whole") if x[0] < number]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def staged(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame | None:
    """path, seq, content: the last of each path up to a batch, or to the latest; None before the first."""
    whole = [x for x in _written(spark, target, "whole") if upto is None or x[0] < upto][-1:]
    since = whole[0][0] if whole else -1
    paths = [p for _, p in whole] + [p for n, p in _written(spark, target, "changes") if n > since and (upto is None or n <= upto)]
    return _last(spark.read.schema(EDIT_SCHEMA).parquet(*paths)) if paths else None


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a history table, each row once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_runs(runs: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """run_target, window_start, run_count, mean_ms, max_ms of windows that late rows can no longer change."""
    valid = runs.withColumn("ts", F.col("ts").cast("timestamp")).filter("duration_ms >= 0").withWatermark("ts", late)
    grouped = valid.groupBy("run_target", F.window("ts", width).alias("w")).agg(F.count("*").alias("run_count"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
    return grouped.select("run_target", F.col("w.start").alias("window_start"), "run_count", "mean_ms", "max_ms")
