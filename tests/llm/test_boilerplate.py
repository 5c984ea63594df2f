"""Texts that have a long common part: every pair shares much, few pairs are alike."""

import random

import pytest
from pyspark.sql import functions as F

from codekiln.llm import cross_split, near_duplicates, rare_shingles
from codekiln.llm.shingles import shingle_sets, similarity


def _texts(n, common=60, own=45, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    head = [word() for _ in range(common)]
    rows = []
    for k in range(n):
        if rows and k % 5 == 0:
            body = rows[rng.randrange(len(rows))].split()[common:]
            body[rng.randrange(len(body))] = word()
        else:
            body = [word() for _ in range(own)]
        rows.append(" ".join(head + body))
    return rows


def _alike(texts, words, threshold):
    sets = list(shingle_sets(texts, words))
    out = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both, either = similarity(sets[a], sets[b])
            if both and both >= threshold * either:
                out.add((a, b))
    return out


@pytest.mark.parametrize(("words", "threshold"), [(4, 0.6), (5, 0.8)])
def test_crowded_bands_lose_no_pair(spark, words, threshold):
    texts = _texts(220)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    params = near_duplicates.NearDuplicateParams(words=words, threshold=threshold, crowd=20, block=7)
    found = near_duplicates.near_duplicates(rows, "id", "text", params)
    assert {(r["id_1"], r["id_2"]) for r in found.links.collect()} == _alike(texts, words, threshold)
    signed = near_duplicates.signatures(rows, "id", "text", params)
    classes = signed.withColumnRenamed("id", "rep")
    most = near_duplicates._keys(classes, rows, params)[1].agg(F.max("n")).first()[0] or 0
    assert most <= 20  # what all texts have in common is no key


def test_ten_times_the_texts_make_ten_times_the_keys(spark):
    sizes = []
    for n in (100, 1000):
        rows = spark.createDataFrame(list(enumerate(_texts(n))), "id long, text string")
        params = near_duplicates.NearDuplicateParams(words=4, threshold=0.6, crowd=20)
        classes = near_duplicates.signatures(rows, "id", "text", params).withColumnRenamed("id", "rep")
        shared = near_duplicates._keys(classes, rows, params)[1]
        sizes.append(shared.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0])
    assert sizes[1] < 20 * sizes[0]


def test_hot_shingles_are_joined_in_blocks(spark):
    texts = _texts(150, common=160, own=30)
    rows = spark.createDataFrame([(k, k % 3 == 0, t) for k, t in enumerate(texts)], "id long, held boolean, text string")
    counters = rare_shingles.shingle_counters(rows.select("text"), 4, 4)  # hardly any order
    signed = rare_shingles.prefixes(rows.withColumn("side", F.col("held").cast("int")), counters, 4, 0.8)
    first, second = signed.filter("side = 0"), signed.filter("side = 1")
    plain = rare_shingles.matching_prefixes(first, second, 0.8)
    blocks = rare_shingles.matching_prefixes(first, second, 0.8, block=3)
    got = {tuple(r) for r in blocks.collect()}
    assert got == {tuple(r) for r in plain.collect()} and got
    docs = rows.select("id", "text", F.when(F.col("held"), "test").otherwise("train").alias("split"))
    pairs = cross_split.cross_split_overlaps(docs, "id", "text", "split", cross_split.CrossSplitParams(words=4, threshold=0.8, counter_bits=4))
    want = {(a, b) if a % 3 else (b, a) for a, b in _alike(texts, 4, 0.8) if (a % 3 == 0) != (b % 3 == 0)}
    assert {tuple(r) for r in pairs.collect()} == want and want <= got


def test_counters_are_exact_and_bounded(spark):
    rows = spark.createDataFrame([("a b c d e",), ("a b c d x",), (None,), ("",)], "text string").repartition(3)
    counts = rare_shingles.shingle_counters(rows, 4, 10)
    assert counts.sum() == 4 and counts.max() >= 2
    assert rare_shingles.FEWEST_BITS <= rare_shingles.counter_bits(rows) <= rare_shingles.MOST_BITS
