"""Session defaults and the scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: dict[str | None, str] = {}


def local_session(name: str = "codekiln", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """This process's folder in the shared one that spark.checkpoint.dir names; it goes when the process ends.

    Where that is unset, a session on this machine alone (tests) gets a temporary
    folder; on a cluster, whose executors can't share one, it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if shared not in _OWN_SCRATCH:
        _OWN_SCRATCH[shared] = os.path.join(shared or tempfile.mkdtemp(prefix="codekiln-"), f"codekiln-{uuid.uuid4().hex}")
        atexit.register(clean_scratch, spark, shared, os.getpid())
    return _OWN_SCRATCH[shared]


def clean_scratch(spark: SparkSession, shared: str | None = None, process: int | None = None) -> None:
    """Deletes what this process has written to its scratch folder; tables that read from it can't be used any more."""
    path = _OWN_SCRATCH.get(shared)
    if path is None or process not in (None, os.getpid()):
        return
    del _OWN_SCRATCH[shared]
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session is gone; what is on this machine can still go
        shutil.rmtree(path, ignore_errors=True)
    if not shared:
        shutil.rmtree(os.path.dirname(path), ignore_errors=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the scratch folder and reads it again.

    The files outlive a lost executor, hold only the columns of df, and give the
    optimizer true sizes, so a later join is broadcast only if the table is small.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that takes long for each row.

    Only inputs of a few partitions are shuffled, such as one small file; large ones
    have more than enough already. Rows and results stay the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
