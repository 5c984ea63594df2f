"""Timed runs: summaries, comparisons, trends and history."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.operators import profiling as p
from codekiln.plans.catalog import table
from codekiln.session import scratch_dir
from codekiln.streaming import pipelines

CUT = "timestamp '2024-06-01 00:00:00'"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return p.clean_runs(table(spark, folder, "runs"), ["run_target"], "duration_ms")


def bench_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Order statistics of every target."""
    return p.timing_summary(_runs(spark, folder), ["run_target"], "duration_ms")


def bench_summary_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's orders' prices as timings; customers without orders have count 0."""
    summary = p.timing_summary(table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_totalprice")
    return p.with_missing(summary, table(spark, folder, "customer"), ["c_custkey"])


def bench_stop_on_failure(spark: SparkSession, folder: str) -> DataFrame:
    """Runs up to the first failed one of a target and day, counted."""
    runs = _runs(spark, folder).withColumn("day", F.to_date("ts"))
    kept = p.until_failure(runs, ["run_target", "day"], ["ts", "run_id"], "exit_code")
    return kept.groupBy("run_target").agg(F.count("*").alias("kept"), F.sum(F.coalesce((F.col("exit_code") != 0).cast("long"), F.lit(0))).alias("failed"))


def bench_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The second half of the year against the first."""
    runs = _runs(spark, folder)
    old = p.timing_summary(runs.filter(f"ts < {CUT}"), ["run_target"], "duration_ms")
    new = p.timing_summary(runs.filter(f"ts >= {CUT}"), ["run_target"], "duration_ms")
    return p.compare_summaries(old, new, ["run_target"])


def bench_trend(spark: SparkSession, folder: str) -> DataFrame:
    return p.trend(_runs(spark, folder), ["run_target"], ["ts", "run_id"], "duration_ms")


def bench_chart(spark: SparkSession, folder: str) -> DataFrame:
    runs = p.history_tail(_runs(spark, folder), ["run_target"], ["ts", "run_id"], 20)
    return p.chart_points(runs, ["run_target"], ["ts", "run_id"], "duration_ms").select("run_target", "run_id", "x", "y")


def history_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last 200 runs of all."""
    return p.history_tail(_runs(spark, folder), [], ["ts", "run_id"], 200).select("run_id", "run_target", "duration_ms")


def history_tail_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return p.history_tail(_runs(spark, folder), ["run_target"], ["ts", "run_id"], 10).select("run_id", "run_target", "duration_ms")


def baseline_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each target's last duration as its baseline; a last run without one clears it."""
    runs = table(spark, folder, "runs").dropDuplicates().withColumn("duration_ms", F.when(F.col("duration_ms") >= 0, F.col("duration_ms")))
    return p.latest_baseline(runs, ["run_target"], ["ts", "run_id", "ingested_at"], "duration_ms")


def latest_staged(spark: SparkSession, folder: str) -> DataFrame:
    """Last write wins for each user's events."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("writes"))


def staged_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of edits, staged: the last of each user's, by number."""
    base = os.path.join(scratch_dir(spark), f"staged-{uuid.uuid4().hex}")
    edits = F.concat(F.lit("user "), "user_id").alias("path"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("content")
    table(spark, folder, "events").select(*edits).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(pipelines.EDIT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    pipelines.stage_edits(stream, f"{base}/out", f"{base}/marks", once=True, compact_every=2).awaitTermination()
    return pipelines.staged(spark, f"{base}/out")


def tumbling_summary(spark: SparkSession, folder: str) -> DataFrame:
    return p.tumbling_summary(_runs(spark, folder), ["run_target"], "ts", "duration_ms", "7 days").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def corpus_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by category and subcategory with subtotals."""
    pairs = table(spark, folder, "code_pairs").select(F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("subcategory", F.lit("none")).alias("subcategory"), F.length("unoptimized").alias("n"))
    return pairs.rollup("category", "subcategory").agg(F.count("*").alias("pairs"), F.sum("n").alias("characters"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows of the runs read as a stream until all of it is used; the last windows stay open."""
    whole = table(spark, folder, "runs")
    base = os.path.join(scratch_dir(spark), f"stream-{uuid.uuid4().hex}")
    whole.select("run_target", "duration_ms", "ts").write.parquet(f"{base}/in")
    runs = spark.readStream.schema(pipelines.RUN_SCHEMA).parquet(f"{base}/in")
    pipelines.append_stream(pipelines.windowed_runs(runs, "1 day"), f"{base}/out", f"{base}/marks").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("run_target").agg(F.count("*").alias("windows"), F.sum("run_count").alias("runs"))


QUERIES = [bench_summary, bench_summary_missing, bench_stop_on_failure, bench_compare, bench_trend, bench_chart, history_tail, history_tail_per_key, baseline_latest, latest_staged, staged_edits, tumbling_summary, corpus_rollup, stream_windows]

_RUNS = "runs_clean as (select distinct * from runs where duration_ms is not null and not isnan(duration_ms) and duration_ms >= 0 and run_target is not null)"


def _summary(source: str, key: str, value: str) -> str:
    return f"""select {key}, count(*) as run_count, min(v) / 1000 as min_ms, max(v) / 1000 as max_ms, ((2 * sum(v) + count(*)) // (2 * count(*))) / 1000 as mean_ms,
        floor(median(v) + 0.5) / 1000 as median_ms, quantile_disc(v, 0.95) / 1000 as p95_ms
        from (select {key}, cast(floor({value} * 1000 + 0.5) as bigint) as v from {source}) group by {key}"""


_CHANGE = """floor((c - b) * 1000 + 0.5) / 1000 as delta_ms, floor(pct * 1000 + 0.5) / 1000 as delta_percent,
    case when b is null then 'slower' when pct < 0 then 'faster' else 'slower' end as direction,
    floor(case when b is null then 0 else greatest(0, -pct) end * 1000 + 0.5) / 1000 as gain_percent, floor(case when b is null then 0 else greatest(0, pct) end * 1000 + 0.5) / 1000 as regression_percent"""

SQL = {
    "bench_summary": f"with {_RUNS} {_summary('runs_clean', 'run_target', 'duration_ms')}",
    "bench_summary_missing": f"with s as ({_summary('orders', 'o_custkey', 'o_totalprice')}) select c_custkey, coalesce(run_count, 0) as run_count, min_ms, max_ms, mean_ms, median_ms, p95_ms from customer left join s on c_custkey = o_custkey",
    "bench_stop_on_failure": f"""with {_RUNS}, f as (select *, coalesce(sum(case when exit_code <> 0 then 1 else 0 end) over (partition by run_target, cast(ts as date) order by ts, run_id rows between unbounded preceding and 1 preceding), 0) as bad from runs_clean)
        select run_target, count(*) as kept, cast(sum(case when exit_code <> 0 then 1 else 0 end) as bigint) as failed from f where bad = 0 group by run_target""",
    "bench_compare": f"""with {_RUNS}, o as ({_summary(f"(select * from runs_clean where ts < {CUT})", 'run_target', 'duration_ms')}), n as ({_summary(f"(select * from runs_clean where ts >= {CUT})", 'run_target', 'duration_ms')}),
        j as (select n.run_target, o.mean_ms as b, n.mean_ms as c, case when o.mean_ms = 0 then 0 else (n.mean_ms - o.mean_ms) / o.mean_ms * 100 end as pct from n left join o using (run_target))
        select run_target, b as baseline_ms, c as current_ms, case when b is null then 'no_baseline' else 'compared' end as status, {_CHANGE} from j""",
    "bench_trend": f"""with {_RUNS}, e as (select run_target, count(*) as points, min(duration_ms) as min_ms, max(duration_ms) as max_ms, arg_min(duration_ms, (ts, run_id)) as first_ms, arg_max(duration_ms, (ts, run_id)) as last_ms from runs_clean group by run_target),
        d as (select *, case when first_ms = 0 then 0 else (last_ms - first_ms) / first_ms * 100 end as pct from e)
        select run_target, points, min_ms, max_ms, first_ms, last_ms, floor(pct * 1000 + 0.5) / 1000 as delta_percent,
        case when points > 1 and pct < -0.1 then 'improvement' when points > 1 and pct > 0.1 then 'regression' else 'flat' end as tone from d""",
    "bench_chart": f"""with {_RUNS}, t as (select * from (select *, row_number() over (partition by run_target order by ts desc, run_id desc) as k from runs_clean) where k <= 20),
        w as (select *, count(*) over (partition by run_target) as n, row_number() over (partition by run_target order by ts, run_id) - 1 as r, min(duration_ms) over (partition by run_target) as lo, max(duration_ms) over (partition by run_target) as hi from t)
        select run_target, run_id, floor((10.0 + (case when n > 1 then cast(r as double) / (n - 1) else 0 end) * 260.0) * 1000 + 0.5) / 1000 as x,
        floor((10.0 + (1 - (duration_ms - lo) / (case when hi > lo then hi - lo else 1.0 end)) * 100.0) * 1000 + 0.5) / 1000 as y from w""",
    "history_tail": f"with {_RUNS} select run_id, run_target, duration_ms from runs_clean order by ts desc, run_id desc limit 200",
    "history_tail_per_key": f"with {_RUNS} select run_id, run_target, duration_ms from (select *, row_number() over (partition by run_target order by ts desc, run_id desc) as k from runs_clean) where k <= 10",
    "baseline_latest": """with d as (select distinct * from runs), l as (select run_target, case when duration_ms >= 0 then duration_ms end as duration_ms, row_number() over (partition by run_target order by ts desc, run_id desc, ingested_at desc) as k from d)
        select run_target, duration_ms from l where k = 1 and duration_ms is not null""",
    "latest_staged": "select user_id, arg_max(value, (ts, event_id)) as value, count(*) as writes from events group by user_id",
    "staged_edits": "select 'user ' || user_id as path, max(event_id) as seq, arg_max(concat_ws(' ', event_type, props), event_id) as content from events where user_id is not null group by user_id",
    "tumbling_summary": f"""with {_RUNS} select run_target, strftime(time_bucket(interval '7 days', cast(ts as timestamp), timestamp '1970-01-01'), '%Y-%m-%d') as window_start, count(*) as run_count, ((2 * sum(cast(floor(duration_ms * 1000 + 0.5) as bigint)) + count(*)) // (2 * count(*))) / 1000 as mean_ms, max(duration_ms) as max_ms from runs_clean group by 1, 2""",
    "stream_windows": """with w as (select run_target, time_bucket(interval '1 day', cast(ts as timestamp), timestamp '1970-01-01') as w, count(*) as n from runs where duration_ms >= 0 group by 1, 2),
        l as (select max(cast(ts as timestamp)) - interval '10 minutes' as mark from runs where duration_ms >= 0) select run_target, count(*) as windows, cast(sum(n) as bigint) as runs from w, l where w + interval '1 day' <= mark group by 1""",
    "corpus_rollup": "select category, subcategory, count(*) as pairs, cast(sum(length(unoptimized)) as bigint) as characters from (select coalesce(category, 'none') as category, coalesce(subcategory, 'none') as subcategory, unoptimized from code_pairs) group by rollup (category, subcategory)",
}
