"""Explanations from templates: chosen by their conditions, filled in, with actions merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.functions.text import rendered
from codekiln.sources.dimensions import literal_pages


def _fits(when: Column, context: Column) -> Column:
    """Every condition holds: equality by key, or for KEY.min a number of at least that; no conditions hold always."""

    def holds(key: Column, expected: Column) -> Column:
        least = key.endswith(".min")
        number = F.element_at(context, F.regexp_replace(key, r"\.min$", "")).try_cast("double") >= expected.try_cast("double")
        return F.coalesce(F.when(least, number).otherwise(F.element_at(context, key) == expected), F.lit(False))

    return F.forall(F.map_entries(when), lambda e: holds(e["key"], e["value"]))


def select_templates(contexts: DataFrame, templates: DataFrame) -> DataFrame:
    """key, template_id, domain, rank, title, summary, actions of the templates that fit each context (key, context map<string,string>), by priority, then in their order."""
    none = F.from_json(F.lit("[]"), f"array<{templates.schema.simpleString()}>")
    chosen = reduce(DataFrame.unionByName, [contexts.withColumn("t", F.explode(F.filter(page, lambda t: _fits(t["when"], F.col("context"))))) for page in literal_pages(templates) or [none]])
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("t.priority").desc(), "t.ordinal"))
    fill = lambda x: rendered(x, F.col("context"))
    return chosen.select("key", F.col("t.id").alias("template_id"), "t.domain", rank.alias("rank"), fill(F.col("t.title")).alias("title"), fill(F.col("t.summary")).alias("summary"), F.transform("t.actions", fill).alias("actions"))


def merged_actions(drafts: DataFrame, most: int = 6) -> DataFrame:
    """key, action_no, action: the actions of all drafts (key, rank, actions) in order, letter case and outer blanks aside once, at most `most`."""
    listed = drafts.select("key", "rank", F.posexplode("actions").alias("no", "action")).withColumn("same", F.lower(F.trim("action"))).filter("same <> ''")
    first = listed.withColumn("k", F.row_number().over(Window.partitionBy("key", "same").orderBy("rank", "no"))).filter("k = 1")
    return first.withColumn("action_no", F.row_number().over(Window.partitionBy("key").orderBy("rank", "no"))).filter(F.col("action_no") <= most).select("key", "action_no", "action")


def refined(drafts: DataFrame, refinements: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """drafts with the fields that refinements (keys and fields) have for them."""
    new = refinements.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = drafts.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in drafts.columns])
