"""Optimization rules over file metrics: matched, scored, calibrated and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.functions.score import band, calibrated, clamp, compared, stl_boost, stl_signal
from codekiln.sources.dimensions import literal_pages

DEFAULT_WEIGHT = 0.15


def issue_pressure(issues: DataFrame) -> DataFrame:
    """file_id and pressure: weighted severities by eight, at most 1. Letter case of severities doesn't count."""
    severity = F.upper("severity")
    weight = F.when(severity == "HIGH", 1.0).when(severity == "MEDIUM", 0.65).when(severity == "LOW", 0.35).otherwise(0.5)
    return issues.groupBy("file_id").agg(clamp(F.sum(weight) / 8, 0, 1).alias("pressure"))


def smell_density(smells: DataFrame) -> DataFrame:
    return smells.groupBy("file_id").agg(clamp(F.count("*") / 5, 0, 1).alias("density"))


def counts_by(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """file_id and a map from each kind to its number."""
    counted = rows.groupBy("file_id", kind).agg(F.count("*").cast("double").alias("n"))
    return counted.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(kind, "n"))).alias(name))


def rule_inputs(features: DataFrame, issues: DataFrame, smells: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each file: metrics, checks and smells as maps, pressure and density."""
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    rows = features.select("file_id", values.alias("metrics"))
    for other in (counts_by(issues, "check_type", "checks"), counts_by(smells, "smell_type", "smells"), issue_pressure(issues), smell_density(smells)):
        rows = rows.join(other, "file_id", "left")
    none = F.create_map().cast("map<string, double>")
    return rows.select("file_id", "metrics", F.coalesce("checks", none).alias("checks"), F.coalesce("smells", none).alias("smells"), F.coalesce("pressure", F.lit(0.0)).alias("pressure"), F.coalesce("density", F.lit(0.0)).alias("density"))


def match_rules(inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """file_id, rule (its struct), matched_weight, possible_weight, hints, boost, preliminary of every rule that fits a file.

    A required condition that fails rules the rule out; an optional one only adds its
    weight. A metric that is missing fails; a check or smell without findings counts
    as 0. Nothing is shuffled: rules are evaluated within each file's row.
    """
    none = F.from_json(F.lit("[]"), f"array<{rules.schema.simpleString()}>")
    rows = reduce(DataFrame.unionByName, [inputs.withColumn("rule", F.explode(page)) for page in literal_pages(rules) or [none]])

    def passed(c: Column) -> Column:
        zero = F.lit(0.0)
        value = F.when(c["type"] == "metric_threshold", F.element_at("metrics", c["metric_path"])).when(c["type"] == "semantic_count", F.coalesce(F.element_at("checks", c["check_type"]), zero)).otherwise(F.coalesce(F.element_at("smells", c["smell_type"]), zero))
        return F.coalesce(compared(value, c["operator"], c["value"]), F.lit(False))

    weight = lambda c: F.coalesce(c["weight"], F.lit(DEFAULT_WEIGHT))
    conditions = F.col("rule.conditions")
    fits = ~F.exists(conditions, lambda c: F.coalesce(c["required"], F.lit(True)) & ~passed(c))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, c: a + weight(c))
    metric = lambda name: F.coalesce(F.element_at("metrics", F.lit(name)), F.lit(0.0))
    signal = stl_signal(metric("stl_container_refs"), metric("stl_algorithm_calls"), metric("stl_iterator_usage"), metric("stl_total"))
    boost = F.when(F.col("rule.category") == "stl", stl_boost(F.col("rule.stl_signal_weight"), signal)).otherwise(0.0)
    hints = F.filter(F.transform(F.filter(conditions, passed), lambda c: F.trim(c["hint"])), lambda h: F.coalesce(h != "", F.lit(False)))
    matched = rows.filter(fits).withColumns({"matched_weight": total(F.filter(conditions, passed)), "possible_weight": total(conditions), "hints": hints, "boost": boost})
    return matched.withColumn("preliminary", F.least(F.col("rule.max_confidence"), F.greatest(F.lit(0.0), F.col("rule.base_confidence") + F.col("matched_weight") + F.col("boost"))))


def rank_suggestions(matched: DataFrame, preview: Column | None = None) -> DataFrame:
    """file_id, rule_id, confidence, band, score, rank (from 1, best first, then in the rules' order), hints."""
    strength = F.when(F.col("possible_weight") > 0, clamp(F.col("matched_weight") / F.col("possible_weight"), 0, 1)).otherwise(0.0)
    confidence = calibrated(F.col("preliminary"), strength, F.col("boost"), F.col("pressure"), F.col("density"), preview if preview is not None else F.lit(0.0), F.col("rule.max_confidence"))
    rows = matched.withColumn("confidence", confidence).withColumn("score", F.col("confidence") + F.col("rule.priority") / 100)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("score").desc(), "rule.ordinal"))
    return rows.select("file_id", F.col("rule.id").alias("rule_id"), "confidence", band(F.col("confidence")).alias("band"), "score", rank.alias("rank"), "hints")


def metrics_long(features: DataFrame, metrics: list[str]) -> DataFrame:
    """file_id, metric_path, value of every metric: dotted or plain paths as rows."""
    return features.select("file_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("file_id", metrics, "metric_path", "value")
