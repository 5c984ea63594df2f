"""Prefixes of rare shingles: what two texts must have in common to be alike.

Shingles are put in one global order, rare ones first. Two texts of likeness t or
more share a shingle within the first n - ceil(t n) + 1 of each, so only those are
indexed and looked up. That holds for any order; a good one makes prefixes of
shingles that few texts have.

Rarity comes from counters over all texts, added up in two levels. Shingles that
share a counter share its count and are then ordered by hash: that is still one
total order, so no pair depends on the number of counters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.llm.shingles import shingle_sets
from codekiln.session import materialize

_CHUNK = 1 << 16
#: Counters are as many as the texts call for, between these powers of 2 (the most are 32 MB as broadcast).
FEWEST_BITS, MOST_BITS = 20, 23
#: Rows of one shingle on either side that one task joins.
BLOCK = 2000


def counter_bits(texts: DataFrame) -> int:
    """How many counters suit texts: one for 256 bytes of what the optimizer takes them for, as a power of 2."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BITS, max(FEWEST_BITS, size.bit_length() - 8))


def shingle_counters(texts: DataFrame, words: int, bits: int | None = None) -> np.ndarray:
    """How many texts have a shingle with each counter; 2^bits numbers. Counts are whole numbers of 64 bits until they are given as floats."""
    bits = counter_bits(texts) if bits is None else bits
    size, chunk = 1 << bits, min(_CHUNK, 1 << bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held, n = [], 0
            for own in shingle_sets(batch["text"], words):
                held.append(own)
                n += len(own)
                if n > 1_000_000:
                    counts += np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size)
                    held, n = [], 0
            if n:
                counts += np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        parts = counts.reshape(-1, chunk)
        # A task's counts are small, so most go in few bytes.
        few = counts.max(initial=0) < 1 << 16
        yield pd.DataFrame({"task": TaskContext.get().partitionId(), "chunk": range(len(parts)), "wide": not few, "counts": [p.astype(np.uint16 if few else np.int64).tobytes() for p in parts]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, dtype=np.int64)
        for wide, x in zip(group["wide"], group["counts"], strict=True):
            total += np.frombuffer(x, dtype=np.int64 if wide else np.uint16)
        return group.iloc[:1].assign(wide=True, counts=[total.tobytes()])

    schema = "task int, chunk int, wide boolean, counts binary"
    fan = max(2, math.isqrt(max(4, texts.rdd.getNumPartitions())))
    partial = texts.mapInPandas(count, schema).withColumn("task", (F.col("task") % fan).cast("int"))
    summed = partial.groupBy("task", "chunk").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    counts = np.zeros((size // chunk, chunk), dtype=np.float32)
    for row in summed.toLocalIterator():  # 2^bits / 65536 rows
        counts[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return counts.ravel()


def prefixes(rows: DataFrame, counters: np.ndarray, words: int, threshold: float) -> DataFrame:
    """A row for each text that has shingles: id, side, set_1, set_2 (a 128-bit name of its shingle set), n (its shingles), tokens (those of its prefix, by position), light (how many of them, from the first on, too few texts have to be hot, see matching_prefixes)."""
    shared = rows.sparkSession.sparkContext.broadcast(counters)
    mask = np.uint64(len(counters) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            out = []
            for one, side, own in zip(batch["id"], batch["side"], shingle_sets(batch["text"], words), strict=True):
                if (n := len(own)) == 0:
                    continue
                first = n - math.ceil(threshold * n - 1e-9) + 1
                order = np.argsort(counts[own & mask], kind="stable")[:first]
                name_1, name_2 = np.add.reduce(own * (own >> np.uint64(7) | np.uint64(1))), np.add.reduce((own ^ np.uint64(0x5BD1E995F00D)) * (own >> np.uint64(19) | np.uint64(1)))
                light = int(np.count_nonzero(counts[own[order] & mask] < 2 * BLOCK))
                out.append((one, side, name_1.astype(np.int64), name_2.astype(np.int64), n, own[order].astype(np.int64), light))
            yield pd.DataFrame(out, columns=["id", "side", "set_1", "set_2", "n", "tokens", "light"])

    return rows.select("id", "side", "text").mapInPandas(run, "id long, side int, set_1 long, set_2 long, n int, tokens array<long>, light int")


def _met_in_blocks(probe: DataFrame, index: DataFrame, first: DataFrame, second: DataFrame, threshold: float, block: int) -> DataFrame:
    """first and second joined on token; hot tokens by blocks of either side."""
    zero, one = F.lit(0), F.lit(1)
    light = F.col("light") if block >= BLOCK else F.lit(0)
    heavy = lambda side: side.select(F.explode(F.slice("tokens", light + 1, F.size("tokens"))).alias("token"))
    sides = heavy(probe).select("token", one.alias("a"), zero.alias("b")).unionByName(heavy(index).select("token", zero.alias("a"), one.alias("b")))
    counts = sides.groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") * F.col("b") > block * block)
    hot = materialize(counts.select("token", F.ceil(F.col("a") / block).cast("int").alias("blocks_1"), F.ceil(F.col("b") / block).cast("int").alias("blocks_2")), "hot")
    if hot.isEmpty():
        return first.join(second, "token")
    length = lambda n: F.floor(F.log(n) / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col(n)
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    warm_1, warm_2 = first.join(hot, "token"), second.join(hot, "token")
    warm_1 = warm_1.withColumn("block_1", F.pmod(F.xxhash64("id_1"), "blocks_1").cast("int")).withColumn("block_2", every("blocks_2"))
    warm_1 = warm_1.withColumn("like", F.explode(F.sequence(length("n_1") - 1, length("n_1") + 1)))
    warm_2 = warm_2.withColumn("block_2", F.pmod(F.xxhash64("id_2"), "blocks_2").cast("int")).withColumn("block_1", every("blocks_1"))
    warm_2 = warm_2.withColumn("like", length("n_2"))
    warm = warm_1.drop("blocks_1", "blocks_2").join(warm_2.drop("blocks_1", "blocks_2"), ["token", "like", "block_1", "block_2"])
    cold = first.join(hot.select("token"), "token", "left_anti").join(second.join(hot.select("token"), "token", "left_anti"), "token")
    return warm.select(*cold.columns).unionByName(cold)


def matching_prefixes(probe: DataFrame, index: DataFrame, threshold: float, block: int = BLOCK, most: float = math.inf) -> DataFrame:
    """Pairs id_1, id_2 of probe and index (id, n, tokens, light) that share a shingle of both prefixes and that length and position allow.

    Shingles with more than block x block combinations are joined in blocks of either
    side, and of like length only; how many there are is counted first, for those that
    as many texts may have by the counters, of which `most` is the largest. No task holds
    all rows of a hot shingle, and none are left out.
    """
    first = probe.select("id", "n", F.posexplode("tokens").alias("pos", "token")).select("token", F.col("id").alias("id_1"), F.col("n").alias("n_1"), F.col("pos").alias("pos_1"))
    second = index.select("id", "n", F.posexplode("tokens").alias("pos", "token")).select("token", F.col("id").alias("id_2"), F.col("n").alias("n_2"), F.col("pos").alias("pos_2"))
    met = first.join(second, "token") if most < 2 * block else _met_in_blocks(probe, index, first, second, threshold, block)
    t = threshold
    long_enough = F.least("n_1", "n_2") >= t * F.greatest("n_1", "n_2") - 1e-9
    reachable = 1 + F.least(F.col("n_1") - F.col("pos_1") - 1, F.col("n_2") - F.col("pos_2") - 1) >= F.ceil(t / (1 + t) * (F.col("n_1") + F.col("n_2")) - 1e-9)
    return met.filter(long_enough & reachable).select("id_1", "id_2").distinct()
