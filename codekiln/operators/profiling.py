"""Summaries, comparisons and trends of timed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.functions.score import rounded
from codekiln.operators.skew import salted_join


def clean_runs(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Exact copies of rows once; null, negative and undefined values out."""
    return runs.dropDuplicates().filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & F.expr(" and ".join(f"{k} is not null" for k in key)))


def timing_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, run_count, min_ms, max_ms, mean_ms, median_ms, p95_ms of the values rounded to thousandths.

    The median is the mean of the middle two, p95 the nearest rank. Equal values of a
    key are counted first, where they are read; ranks are then sums of counts over
    the distinct values, so a key with very many runs is never sorted run by run.
    Sums are of whole thousandths, so no order of adding shows. Null values don't
    count; keys without any value are missing (see with_missing).
    """
    thousandths = F.floor(F.col(value) * 1000 + 0.5)
    counted = runs.filter(F.col(value).isNotNull()).groupBy(*keys, thousandths.alias("v")).agg(F.count("*").alias("c"))
    ordered = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(ordered)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    n = F.col("n")
    found = ranked.groupBy(*keys).agg(
        F.sum("c").alias("run_count"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.sum(F.col("v") * F.col("c")).alias("s"),
        at(F.floor((n + 1) / 2)).alias("left"),
        at(F.floor((n + 2) / 2)).alias("right"),
        at(F.greatest(F.lit(1), F.ceil(n * 0.95))).alias("p95"),
    )
    ms = lambda x: x / 1000.0
    return found.select(*keys, "run_count", ms(F.col("low")).alias("min_ms"), ms(F.col("high")).alias("max_ms"), ms(_mean("s", "run_count")).alias("mean_ms"), ms(F.expr("floor((left + right + 1) / 2)")).alias("median_ms"), ms(F.col("p95")).alias("p95_ms"))


def _mean(total: str, count: str) -> Column:
    """The mean of whole numbers of at least 0, rounded half up."""
    return F.expr(f"(2 * {total} + {count}) div (2 * {count})")


def with_missing(summary: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every target; those without runs have count 0 and nulls."""
    return targets.select(*keys).distinct().join(summary, keys, "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def until_failure(runs: DataFrame, keys: list[str], order: list[str], code: str) -> DataFrame:
    """The runs of each key up to its first non-zero exit, that one included; a null code is no failure, and null keys are a key.

    The first failure of a key is found where its runs are read, so the runs of one
    key are never brought together.
    """
    rows = runs.withColumns({"__key": F.to_json(F.struct(*keys)), "__at": F.struct(*order)})
    first = rows.filter(F.col(code) != 0).groupBy("__key").agg(F.min("__at").alias("__first"))
    kept = salted_join(rows, first, ["__key"], order[-1], "left").filter(F.col("__first").isNull() | (F.col("__at") <= F.col("__first")))
    return kept.select(*runs.columns)


def change(baseline: Column, current: Column) -> dict[str, Column]:
    """Difference, percent (0 for a baseline of 0), direction (equal counts as slower), gain and regression."""
    delta = current - baseline
    percent = F.when(baseline == 0, 0.0).otherwise(delta / baseline * 100)
    return {
        "delta_ms": rounded(delta),
        "delta_percent": rounded(percent),
        "direction": F.when(percent < 0, "faster").otherwise("slower"),
        "gain_percent": rounded(F.greatest(F.lit(0.0), -percent)),
        "regression_percent": rounded(F.greatest(F.lit(0.0), percent)),
    }


def compare_summaries(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, baseline_ms, current_ms and their change, by means; a key without a baseline has status no_baseline."""
    old = baseline.select(*keys, F.col("mean_ms").alias("baseline_ms"))
    new = current.select(*keys, F.col("mean_ms").alias("current_ms"))
    joined = new.join(old, keys, "left")
    status = F.when(F.col("baseline_ms").isNull(), "no_baseline").otherwise("compared").alias("status")
    return joined.select(*keys, "baseline_ms", "current_ms", status, *[c.alias(n) for n, c in change(F.col("baseline_ms"), F.col("current_ms")).items()])


def history_tail(history: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """The last `keep` rows of each key, or of all for no keys; order must be total. A report, not a rewrite.

    Without keys the last rows are a top-k, which needs no single task for all rows.
    """
    latest = [F.col(c).desc() for c in order]
    if not keys:
        return history.orderBy(*latest).limit(keep)
    return history.withColumn("from_last", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))).filter(F.col("from_last") <= keep).drop("from_last")


def trend(history: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """keys, points, min_ms, max_ms, first_ms, last_ms, delta_percent, tone; flat within a tenth of a percent, and for one point."""
    when = F.struct(*at)
    valid = history.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = valid.groupBy(*keys).agg(F.count("*").alias("points"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.min_by(value, when).alias("first_ms"), F.max_by(value, when).alias("last_ms"))
    percent = F.when(F.col("first_ms") == 0, 0.0).otherwise((F.col("last_ms") - F.col("first_ms")) / F.col("first_ms") * 100)
    tone = F.when((F.col("points") > 1) & (percent < -0.1), "improvement").when((F.col("points") > 1) & (percent > 0.1), "regression").otherwise("flat")
    return ends.select("*", rounded(percent).alias("delta_percent"), tone.alias("tone"))


def chart_points(history: DataFrame, keys: list[str], order: list[str], value: str, width: float = 280, height: float = 120, padding: float = 10) -> DataFrame:
    """history with x and y of its points on a chart of each key."""
    own = Window.partitionBy(*keys)
    n, rank = F.count("*").over(own), F.row_number().over(own.orderBy(*order)) - 1
    low, high = F.min(value).over(own), F.max(value).over(own)
    span = F.when(high > low, high - low).otherwise(1.0)
    ratio = F.when(n > 1, rank / (n - 1)).otherwise(0.0)
    return history.withColumn("x", rounded(padding + ratio * (width - 2 * padding))).withColumn("y", rounded(padding + (1 - (F.col(value) - low) / span) * (height - 2 * padding)))


def latest_baseline(baselines: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """The last value set for each key; a null value clears it."""
    return baselines.groupBy(*keys).agg(F.max_by(value, F.struct(*at)).alias(value)).filter(F.col(value).isNotNull())


def tumbling_summary(runs: DataFrame, keys: list[str], at: str, value: str, width: str = "1 day") -> DataFrame:
    """Counts, means and greatest values in windows of time."""
    grouped = runs.groupBy(*keys, F.window(at, width).alias("w")).agg(F.count(value).alias("run_count"), F.sum(F.floor(F.col(value) * 1000 + 0.5)).alias("s"), F.max(value).alias("max_ms"))
    return grouped.select(*keys, F.col("w.start").alias("window_start"), "run_count", (_mean("s", "run_count") / 1000.0).alias("mean_ms"), "max_ms")
