"""Exact likeness of candidate pairs, and what pairs of class representatives stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.llm.shingles import shingle_sets, similarity
from codekiln.operators.skew import salted_join
from codekiln.session import materialize


def verify_pairs(pairs: DataFrame, texts: DataFrame, words: int, threshold: float, block: int = 4000) -> DataFrame:
    """Pairs (id_1, id_2) whose texts (id, text) are at least `threshold` alike: id_1, id_2, shared, either.

    Pairs of relatives are brought together: the key of a pair is the smallest
    partner of its id_2, so a family's texts travel about once each. A key with
    more than `block` pairs is split into blocks of about that many, each with
    only the texts it needs; a task holds one block's sets at a time.
    """
    pairs = materialize(pairs.select("id_1", "id_2"), "candidates")
    near = pairs.groupBy("id_2").agg(F.min("id_1").alias("key"))
    keyed = salted_join(pairs, near, ["id_2"], "id_1", salts=8)
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = salted_join(keyed, sizes, ["key"], "id_1").withColumn("block", F.pmod(F.xxhash64("id_1", "id_2"), "blocks")).drop("blocks")
    placed = materialize(placed, "placed")
    needs = placed.select("key", "block", F.explode(F.array("id_1", "id_2")).alias("id")).distinct()
    wanted = needs.join(texts, "id").select("key", "block", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("other"), "text")
    asked = placed.select("key", "block", F.lit(1).alias("kind"), F.col("id_1").alias("id"), F.col("id_2").alias("other"), F.lit(None).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, sets = None, {}
        for batch in batches:
            found = []
            docs = batch["kind"].to_numpy() == 0
            made = shingle_sets(batch["text"].to_numpy()[docs], words)
            for key, part, kind, a, b in zip(batch["key"], batch["block"], batch["kind"], batch["id"], batch["other"], strict=True):
                if here != (key, part):
                    here, sets = (key, part), {}
                if kind == 0:
                    sets[a] = next(made)
                elif a in sets and b in sets:
                    both, either = similarity(sets[a], sets[b])
                    if either and both >= threshold * either:
                        found.append((a, b, both, either))
            yield pd.DataFrame(found, columns=["id_1", "id_2", "shared", "either"]).astype(np.int64)

    together = wanted.unionByName(asked).repartition("key", "block").sortWithinPartitions("key", "block", "kind")
    return together.mapInPandas(run, "id_1 long, id_2 long, shared long, either long")


def _member_blocks(members: DataFrame, block: int) -> DataFrame:
    """rep, block, ids: the members (rep, id) of each class in arrays of about `block` at most."""
    crowds = members.groupBy("rep").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1")
    placed = salted_join(members.select("rep", "id"), crowds, ["rep"], "id", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    return materialize(placed.groupBy("rep", "block").agg(F.collect_list("id").alias("ids")), "blocks")


def _combinations(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """All row_1, row_2 behind pairs; blocks of members are paired first and spread over tasks, where they become rows."""
    own = _member_blocks(left, block)
    first = own.select(F.col("rep").alias("id_1"), F.col("block").alias("block_1"), F.col("ids").alias("ids_1"))
    second = (own if left is right else _member_blocks(right, block)).select(F.col("rep").alias("id_2"), F.col("block").alias("block_2"), F.col("ids").alias("ids_2"))
    met = pairs.join(first, "id_1").join(second, "id_2")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "id_1", "block_1", "id_2", "block_2").select("ids_1", "ids_2")
    return met.select(F.explode("ids_1").alias("row_1"), "ids_2").select("row_1", F.explode("ids_2").alias("row_2"))


def linked_members(pairs: DataFrame, left: DataFrame, right: DataFrame, expand: int | None = None, block: int = 1000) -> DataFrame:
    """Pairs of rows behind pairs (id_1, id_2) of class representatives: row_1 of left, row_2 of right.

    left and right hold (rep, id), a row for each member of a class. All
    combinations come out, in tasks of about block x block at a time. If `expand` is
    given, two classes with more combinations give only each member with the other
    class's representative, from which, with the classes, every combination follows.
    """
    pairs = materialize(pairs.select("id_1", "id_2"), "linked")
    if expand is None:
        return _combinations(pairs, left, right, block)
    sizes_1 = left.groupBy("rep").agg(F.count("*").alias("n_1")).withColumnRenamed("rep", "id_1")
    sizes_2 = right.groupBy("rep").agg(F.count("*").alias("n_2")).withColumnRenamed("rep", "id_2")
    sized = materialize(pairs.join(sizes_1, "id_1").join(sizes_2, "id_2"), "sized")
    few = sized.filter(F.col("n_1") * F.col("n_2") <= expand).select("id_1", "id_2")
    many = sized.filter(F.col("n_1") * F.col("n_2") > expand).select("id_1", "id_2")
    members_1 = left.select(F.col("rep").alias("id_1"), F.col("id").alias("row_1"))
    members_2 = right.select(F.col("rep").alias("id_2"), F.col("id").alias("row_2"))
    spoke_1 = salted_join(members_1, many, ["id_1"], "row_1").select("row_1", F.col("id_2").alias("row_2"))
    spoke_2 = salted_join(members_2, many, ["id_2"], "row_2").select(F.col("id_1").alias("row_1"), "row_2")
    return _combinations(few, left, right, block).unionByName(spoke_1.unionByName(spoke_2).distinct())
