"""Algorithms recommended for texts by keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.functions.text import word_set


def recommend(texts: DataFrame, key: str, text: str, algorithms: DataFrame) -> DataFrame:
    """key, name, score: two for each keyword and one for each category that a text has; those with a blank as a part of it.

    One-word keywords meet the texts' words in a join on the word; phrases are looked
    for in the text, phrase by phrase (they are a dimension of a bounded size).
    """
    terms = algorithms.select("name", F.explode(F.concat(F.transform("keywords", lambda k: F.struct(F.lower(k).alias("term"), F.lit(2).alias("weight"))), F.transform("categories", lambda k: F.struct(F.lower(k).alias("term"), F.lit(1).alias("weight"))))).alias("x")).select("name", "x.*")
    rows = texts.select(F.col(key), F.col(text).alias("text")).filter("text is not null")
    words = rows.select(key, F.explode(word_set(F.col("text"))).alias("term"))
    single = words.join(terms.filter("not contains(term, ' ')"), "term").select(key, "name", "weight")
    phrases = [r for r in terms.filter("contains(term, ' ')").collect()]
    parts = single
    if phrases:
        listed = F.array(*[F.struct(F.lit(p["term"]).alias("term"), F.lit(p["name"]).alias("name"), F.lit(p["weight"]).alias("weight")) for p in phrases])
        found = rows.select(key, F.explode(F.filter(listed, lambda p: F.contains(F.lower("text"), p["term"]))).alias("x"))
        parts = single.unionByName(found.select(key, "x.name", "x.weight"))
    return parts.groupBy(key, "name").agg(F.sum("weight").alias("score"))
