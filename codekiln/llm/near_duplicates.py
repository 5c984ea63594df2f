"""Near-duplicate texts: banded candidates, sequential Bayesian pruning, exact verification.

A text's signature has bands x rows minimum hashes of its word shingles. Texts
that agree in all rows of a band become candidates. A candidate is followed
through its signature a batch of hashes at a time and is dropped as soon as the
posterior probability that its likeness reaches the threshold falls below the
chosen miss probability. What is left is verified on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.llm.rare_shingles import prefixes, shingle_counters
from codekiln.llm.shingles import mix, shingle_sets
from codekiln.llm.verify import linked_members, verify_pairs
from codekiln.operators.skew import salted_join
from codekiln.session import materialize, spread


@dataclass(frozen=True)
class NearDuplicateParams:
    """threshold and words: likeness of distinct runs of `words` words. A pair at the
    threshold has no common band with probability (1 - threshold^rows)^bands, and is
    pruned with at most `miss` at each of the signature's batches. `crowd`: classes of a
    band above which its pairs are told apart by rare shingles, too; up to there comparing
    all costs less than shingling again. `block`: rows that are compared at a time. `expand`: see linked_members."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 48
    rows: int = 3
    batch: int = 16
    miss: float = 1e-6
    crowd: int = 10_000
    block: int = 500
    expand: int | None = None


def _binomial_below(n: int, p: float, m: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m + 1))


def least_matches(params: NearDuplicateParams) -> list[tuple[int, int]]:
    """(hashes seen, matches needed to go on) for each batch of the signature.

    One byte of each minimum is kept, mixed since minima of long texts are near 0, so hashes match with p = s + (1 - s) / 256 at
    likeness s. With a uniform prior, P(p >= q | m of n match) is the chance of at
    most m successes in n + 1 trials of chance q.
    """
    q = params.threshold + (1 - params.threshold) / 256
    total = params.bands * params.rows
    return [(n, next(m for m in range(n + 2) if m > n or _binomial_below(n + 1, q, m) >= params.miss)) for n in range(params.batch, total + 1, params.batch)]


def signatures(docs: DataFrame, id_col: str, text_col: str, params: NearDuplicateParams) -> DataFrame:
    """id, set_1 and set_2 (a 128-bit name of the shingle set), bands (a key for each band), signature (bytes)."""
    size, words, bands, rows = params.bands * params.rows, params.words, params.bands, params.rows
    seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flips, factors = (seeds[:size] >> np.uint64(32)).astype(np.uint32)[:, None], seeds[size:].astype(np.uint32)[:, None] | np.uint32(1)
    band_seeds = mix(np.arange(7, bands + 7, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, names_1, names_2, keys, bodies = [], [], [], [], []
            for one, own in zip(batch["id"], shingle_sets(batch["text"], words), strict=True):
                if not len(own):
                    continue
                half = (own >> np.uint64(32)).astype(np.uint32)
                least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
                for at in range(0, len(half), 4096):
                    h = (half[at : at + 4096] ^ flips) * factors
                    np.minimum(least, (h ^ (h >> np.uint32(15))).min(axis=1), out=least)
                wide = least.reshape(bands, rows).astype(np.uint64)
                key = band_seeds.copy()
                for r in range(rows):
                    key = mix(key ^ wide[:, r])
                ids.append(one)
                names_1.append(np.add.reduce(mix(own ^ np.uint64(0x5BD1E995))).astype(np.int64))
                names_2.append(np.add.reduce(mix(own + np.uint64(len(own)))).astype(np.int64))
                keys.append(key.astype(np.int64))
                bodies.append((mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"id": ids, "set_1": names_1, "set_2": names_2, "bands": pd.Series(keys, dtype=object), "signature": pd.Series(bodies, dtype=object)})

    rows_in = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null"))
    return rows_in.mapInPandas(run, "id long, set_1 long, set_2 long, bands array<long>, signature binary")


def _survivors(buckets: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """Pairs (id_1, id_2) of rows (key, block_1, block_2, id, side, signature) that no batch of hashes rules out."""
    steps, at_once = least_matches(params), 200_000

    def compare(ids: np.ndarray, bodies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        matches, before = np.zeros(len(a), dtype=np.int32), 0
        for n, needed in steps:
            matches += (bodies[a, before:n] == bodies[b, before:n]).sum(axis=1, dtype=np.int32)
            keep = matches >= needed
            a, b, matches, before = a[keep], b[keep], matches[keep], n
        one, two = ids[a], ids[b]
        return pd.DataFrame({"id_1": np.minimum(one, two), "id_2": np.maximum(one, two)}).drop_duplicates()

    def groups(table: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names = table[["key", "block_1", "block_2"]].to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        bodies = np.frombuffer(b"".join(table["signature"]), dtype=np.uint8).reshape(len(table), -1)
        left, right, n = [], [], 0
        for start, end in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(table)]]), strict=True):
            if names[start, 1] == names[start, 2]:
                a, b = np.triu_indices(end - start, 1)
            else:
                first, second = np.flatnonzero(side[start:end] == 0), np.flatnonzero(side[start:end] == 1)
                a, b = np.repeat(first, len(second)), np.tile(second, len(first))
            left.append(a + start)
            right.append(b + start)
            n += len(a)
            if n > at_once:
                yield compare(ids, bodies, np.concatenate(left), np.concatenate(right))
                left, right, n = [], [], 0
        if n:
            yield compare(ids, bodies, np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            table = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(table):
                continue
            last = table[["key", "block_1", "block_2"]].to_numpy()
            same = (last == last[-1]).all(axis=1)
            held = table[same]
            if not same.all():
                yield from groups(table[~same].reset_index(drop=True))
        if held is not None and len(held):
            yield from groups(held.reset_index(drop=True))

    placed = buckets.repartition("key", "block_1", "block_2").sortWithinPartitions("key", "block_1", "block_2")
    return placed.mapInPandas(run, "id_1 long, id_2 long").distinct()


def _shared(keys: DataFrame) -> DataFrame:
    """key, n of the keys that several classes have."""
    return materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")


def _keys(classes: DataFrame, texts: DataFrame, params: NearDuplicateParams) -> tuple[DataFrame, DataFrame]:
    """id, key: classes that share a key are to be compared; and key, n of the shared ones.

    Keys are those of bands, but for bands with more than params.crowd classes, such as
    those of texts with a long common part. The classes of all such bands get their
    rare shingles as keys instead: two that share none of them can't be alike enough, so
    nothing is lost, and what many have in common isn't rare.
    """
    keys = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    shared = _shared(keys)
    crowds = shared.filter(F.col("n") > params.crowd).select("key")
    if crowds.isEmpty():
        return keys, shared
    crowded = salted_join(keys, crowds, ["key"], "id").select("id").distinct()
    rows = materialize(texts.join(crowded, "id").select("id", F.lit(0).alias("side"), "text"), "crowded")
    rows = spread(rows)
    rare = prefixes(rows, shingle_counters(rows.select("text"), params.words), params.words, params.threshold)
    keys = materialize(keys.join(crowds, "key", "left_anti").unionByName(rare.select("id", F.explode("tokens").alias("key"))), "keys")
    return keys, _shared(keys)


def banded_candidates(classes: DataFrame, texts: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """Pairs of classes (rep, bands, signature) that share a band and survive the Bayesian comparison. texts: id, text of the representatives among others.

    A key with more than params.block classes is compared block by block, in as many
    tasks; pairs are pruned where they are made.
    """
    keys, shared = _keys(classes, texts, params)
    crowds = shared.select("key", F.ceil(F.col("n") / params.block).cast("int").alias("blocks"))
    placed = salted_join(keys, crowds, ["key"], "id", salts=4).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    sent = placed.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = sent.select("key", "id", F.least("own", "other").alias("block_1"), F.greatest("own", "other").alias("block_2"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    bodies = classes.select(F.col("rep").alias("id"), "signature")
    return _survivors(placed.join(bodies, "id"), params)


@dataclass(frozen=True)
class NearDuplicates:
    """members: id, rep (the smallest id with the same shingle set). links: id_1, id_2,
    shared, either, of representatives."""

    members: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, params: NearDuplicateParams) -> NearDuplicates:
    """All links between texts of at least params.threshold likeness.

    Rows with equal shingle sets form one class, however many they are; classes are
    linked through their representatives. Null ids, null texts and texts of fewer
    words than a shingle has are in no class. Repeated rows count once as a member.
    An empty table gives empty results; other columns of docs are ignored.
    """
    signed = materialize(signatures(docs, id_col, text_col, params), "signatures")
    classes = signed.groupBy("set_1", "set_2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    several = classes.filter("n > 1").select("set_1", "set_2", "rep")
    members = salted_join(signed.select("id", "set_1", "set_2"), several, ["set_1", "set_2"], "id", "left")
    members = materialize(members.select("id", F.coalesce("rep", "id").alias("rep")).distinct(), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    links = verify_pairs(banded_candidates(classes, texts, params), texts, params.words, params.threshold)
    return NearDuplicates(members, materialize(links, "links"))


def row_pairs(found: NearDuplicates, expand: int | None = None) -> DataFrame:
    """pair_id_1 < pair_id_2 of rows, copies included, all of them unless `expand` is given; see linked_members."""
    own = found.members.groupBy("rep").count().filter("count > 1").select(F.col("rep").alias("id_1"), F.col("rep").alias("id_2"))
    between = linked_members(found.links, found.members, found.members, expand)
    within = linked_members(own, found.members, found.members, expand)
    if expand is None:
        within = within.filter("row_1 < row_2")  # both orders come
    rows = between.unionByName(within).filter("row_1 <> row_2").select(F.least("row_1", "row_2").alias("pair_id_1"), F.greatest("row_1", "row_2").alias("pair_id_2"))
    # A pair comes more than once only where an id has several texts, or as a star.
    once = expand is None and found.members.groupBy("id").count().filter("count > 1").isEmpty()
    return rows if once else rows.distinct()


def connected_groups(pairs: DataFrame) -> DataFrame:
    """id, group_id (the smallest id that can be reached) of every id in pairs (id_1, id_2).

    Alternates large-star and small-star steps on a written edge table until it
    stands still; only its count and checksum reach the driver.
    """
    edges = materialize(pairs.select(F.greatest("id_1", "id_2").alias("u"), F.least("id_1", "id_2").alias("v")).filter("u <> v").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = salted_join(both, least, ["u"], "v")
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while before != (now := state(edges)):
        before = now
        edges = materialize(star(star(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("group_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots)


def group_rows(found: NearDuplicates) -> DataFrame:
    """pair_id, class_id, group_id, links (of its class with others) of every member row; without links a group is its class."""
    groups = connected_groups(found.links)
    ends = found.links.select(F.explode(F.array("id_1", "id_2")).alias("id"))
    linked = ends.groupBy("id").agg(F.count("*").alias("links")).join(groups, "id").withColumnRenamed("id", "rep")
    rows = salted_join(found.members, linked, ["rep"], "id", "left")
    return rows.select(F.col("id").alias("pair_id"), F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
