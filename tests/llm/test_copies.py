"""Queries over a group of very many copies, more than 10,000 combinations of rows."""

import pytest

from codekiln.llm import queries, verify

QUERIES = queries.queries()
TRAIN, HELD = 150, 80


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """150 training and 80 test rows of equal shingle sets in two raw texts, and a near relative of theirs in validation."""
    folder = tmp_path_factory.mktemp("copies")
    texts = ["one two three four five six seven eight nine ten", "One, two; three four five six seven eight nine TEN"]
    rows = [(k, texts[k % 2], "train" if k < TRAIN else "test", "s", ["risk_low", "risk_high", None][k % 3]) for k in range(TRAIN + HELD)]
    rows.append((1000, texts[0] + " eleven", "dev", None, "risk_low"))
    spark.createDataFrame(rows, "pair_id long, unoptimized string, split string, source string, performance_risk string").write.parquet(f"{folder}/code_pairs.parquet")
    return rows, str(folder)


def test_report_counts_all_links(spark, copies):
    rows, folder = copies
    train, counts = [r[4] for r in rows if r[2] == "train"], {}
    for _, _, split, source, label in rows:
        if split != "train":
            side = counts.setdefault(({"dev": "validation"}.get(split, split), source), [0, 0, 0, 0, 0])
            agree, bare = sum(label is not None and label == x for x in train), sum(label is None or x is None for x in train)
            for k, n in enumerate((1, 1, TRAIN, agree, bare)):
                side[k] += n
    assert {(r[0], r[1]): list(r[2:]) for r in QUERIES["p6_report"](spark, folder).collect()} == counts


def test_all_pairs_of_many_copies(spark, copies):
    rows, folder = copies
    ids = [r[0] for r in rows]
    assert sorted(map(tuple, QUERIES["p5_found"](spark, folder).collect())) == [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    train, held = ids[:TRAIN], ids[TRAIN:]
    assert sorted(map(tuple, QUERIES["p6_found"](spark, folder).collect())) == [(a, b) for a in train for b in held]


def test_blocks_of_members_give_all_combinations(spark):
    left = spark.createDataFrame([(0, k) for k in range(30)] + [(100, 100)], "rep long, id long")
    right = spark.createDataFrame([(200, 200 + k) for k in range(25)], "rep long, id long")
    links = spark.createDataFrame([(0, 200), (100, 200)], "id_1 long, id_2 long")
    got = sorted(map(tuple, verify.linked_members(links, left, right, block=4).collect()))
    assert got == [(a, b) for a in [*range(30), 100] for b in range(200, 225)]
