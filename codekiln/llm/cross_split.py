"""Overlaps between evaluation splits and the training split by an exact prefix-filter join.

Prefixes of rare shingles of evaluation texts are indexed and those of training
texts probe them, with the filters on length and position in the join (see
rare_shingles). Candidates are verified exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekiln.llm.rare_shingles import matching_prefixes, prefixes, shingle_counters
from codekiln.llm.verify import linked_members, verify_pairs
from codekiln.operators.skew import salted_join
from codekiln.session import materialize, spread


@dataclass(frozen=True)
class CrossSplitParams:
    """words and threshold as for near duplicates; 2^counter_bits counters of rarity, as many as the size of the texts calls for if it is None."""

    words: int = 5
    threshold: float = 0.8
    counter_bits: int | None = None
    expand: int | None = None


def split_side(split: Column) -> Column:
    """train, validation or test for the spellings in use; null for any other value."""
    plain = F.lower(F.trim(split))
    return (
        F.when(plain.isin("train", "training"), "train")
        .when(plain.isin("validation", "valid", "val", "dev"), "validation")
        .when(plain.isin("test", "testing"), "test")
    )


@dataclass(frozen=True)
class CrossSplitLinks:
    """members: evaluation, rep (the smallest id of its side with the same shingle set), id.
    links: id_1, id_2, shared, either, of a training and an evaluation representative."""

    members: DataFrame
    links: DataFrame


def cross_split_links(docs: DataFrame, id_col: str, text_col: str, split_col: str, params: CrossSplitParams) -> CrossSplitLinks:
    """The classes of training and of evaluation rows that are at least params.threshold alike.

    Rows whose split is null or unknown, null ids and texts, and texts of fewer words
    than a shingle has are left out. Rows of one side with equal shingle sets form a
    class and are compared once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), split_side(F.col(split_col)).alias("side"), F.col(text_col).alias("text"))
    rows = rows.filter("id is not null and text is not null and side is not null").select("id", F.col("side").isin("validation", "test").alias("evaluation"), "text")
    rows = spread(rows)
    counters = shingle_counters(rows.select("text"), params.words, params.counter_bits)
    signed = prefixes(rows.withColumn("side", F.col("evaluation").cast("int")), counters, params.words, params.threshold)
    signed = materialize(signed.withColumn("evaluation", F.col("side") == 1).drop("side"), "prefixes")
    classes = signed.groupBy("evaluation", "set_1", "set_2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("light").alias("light"))
    classes = materialize(classes, "classes")
    several = classes.filter("copies > 1").select("evaluation", "set_1", "set_2", "rep")
    members = salted_join(signed.select("id", "evaluation", "set_1", "set_2"), several, ["evaluation", "set_1", "set_2"], "id", "left")
    members = materialize(members.select("evaluation", F.coalesce("rep", "id").alias("rep"), "id").distinct(), "members")
    sides = (classes.filter(side).select(F.col("rep").alias("id"), "n", "tokens", "light") for side in ("not evaluation", "evaluation"))
    met = matching_prefixes(*sides, params.threshold, most=float(counters.max(initial=0)))
    return CrossSplitLinks(members, verify_pairs(met, rows.select("id", "text"), params.words, params.threshold))


def cross_split_overlaps(docs: DataFrame, id_col: str, text_col: str, split_col: str, params: CrossSplitParams) -> DataFrame:
    """train_id, eval_id of every training row and evaluation row at least params.threshold alike (see cross_split_links).

    The members of two linked classes come out each; params.expand: see linked_members.
    """
    found = cross_split_links(docs, id_col, text_col, split_col, params)
    train, evaluation = (found.members.filter(side).select("rep", "id") for side in ("not evaluation", "evaluation"))
    pairs = linked_members(found.links, train, evaluation, params.expand)
    return pairs.select(F.col("row_1").alias("train_id"), F.col("row_2").alias("eval_id"))


def _labelled(docs: DataFrame, id_col: str, split_col: str, source_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """id, side, of, label of all rows, and of those of an evaluation split."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), split_side(F.col(split_col)).alias("side"), F.col(source_col).alias("of"), F.col(label_col).alias("label"))
    return base, base.filter(F.col("side").isin("validation", "test"))


def _reported(evaluation: DataFrame, by_row: DataFrame) -> DataFrame:
    """The report of evaluation rows and by_row (id, links, agree, unlabelled)."""
    none = F.lit(0).cast("long")
    return (
        evaluation.join(by_row, "id", "left")
        .groupBy(F.col("side").alias("split"), F.col("of").alias("source"))
        .agg(
            F.count("*").alias("rows"),
            F.count("links").alias("overlapping_rows"),
            F.coalesce(F.sum("links"), none).alias("links"),
            F.coalesce(F.sum("agree"), none).alias("agreeing_links"),
            F.coalesce(F.sum("unlabelled"), none).alias("unlabelled_links"),
        )
    )


def overlap_report(docs: DataFrame, pairs: DataFrame, id_col: str, split_col: str, source_col: str, label_col: str) -> DataFrame:
    """split, source, rows, overlapping_rows, links, agreeing_links, unlabelled_links for each evaluation split and source.

    A link agrees if both rows have the same label; one with a null label is
    unlabelled. A null source is a source of its own. What pairs leave out isn't
    counted; class_report counts all links without making them.
    """
    base, evaluation = _labelled(docs, id_col, split_col, source_col, label_col)
    named = pairs.join(base.select(F.col("id").alias("train_id"), F.col("label").alias("train_label")), "train_id")
    by_row = (
        named.join(evaluation.select(F.col("id").alias("eval_id"), "label"), "eval_id")
        .groupBy("eval_id")
        .agg(F.count("*").alias("links"), F.sum((F.col("label") == F.col("train_label")).cast("long")).alias("agree"), F.sum((F.col("label").isNull() | F.col("train_label").isNull()).cast("long")).alias("unlabelled"))
    )
    return _reported(evaluation, by_row.withColumnRenamed("eval_id", "id"))


def class_report(docs: DataFrame, found: CrossSplitLinks, id_col: str, split_col: str, source_col: str, label_col: str) -> DataFrame:
    """The overlap_report of all pairs that found stands for, whatever the size of its classes.

    Training rows are counted by class and label, so each evaluation row meets one
    row for each label of what its class is linked to and no pair of rows is made.
    """
    base, evaluation = _labelled(docs, id_col, split_col, source_col, label_col)
    train = found.members.filter("not evaluation").join(base.select("id", "label"), "id").groupBy("rep", "label").agg(F.count("*").alias("n"))
    heard = found.links.select(F.col("id_1").alias("rep"), "id_2").join(train, "rep").groupBy("id_2", "label").agg(F.sum("n").alias("n"))
    heard = materialize(heard.select(F.col("id_2").alias("rep"), "label", "n"), "heard")
    totals = heard.groupBy("rep").agg(F.sum("n").alias("links"), F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("bare"))
    rows = found.members.filter("evaluation").select("rep", "id").join(evaluation.select("id", "label"), "id")
    rows = salted_join(salted_join(rows, totals, ["rep"], "id"), heard.withColumnRenamed("n", "agree"), ["rep", "label"], "id", "left")
    by_row = rows.groupBy("id").agg(F.sum("links").alias("links"), F.sum("agree").alias("agree"), F.sum(F.when(F.col("label").isNull(), F.col("links")).otherwise(F.col("bare"))).alias("unlabelled"))
    return _reported(evaluation, by_row)
