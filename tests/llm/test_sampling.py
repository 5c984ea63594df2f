import numpy as np
import pandas as pd

from codekiln.llm import mixing
from codekiln.llm.mixing import _pick


def _group(sizes, rates, start):
    n = len(sizes)
    rng = np.random.default_rng(1)
    return pd.DataFrame({"doc_id": range(n), "source": "a", "n_tokens": sizes, "rate": rates, "part": 0, "draw": rng.random(n), "chance": rng.random(n), "start": start})


def test_every_document_has_its_probability():
    sizes, rates = [5, 900, 20, 20, 7, 300, 40, 1], [0.1, 0.1, 2.3, 0.5, 0.0, 1.0, 0.75, 3.05]
    taken = np.zeros(8)
    rng = np.random.default_rng(7)
    for _ in range(4000):
        got = _pick(_group(sizes, rates, rng.random()).assign(chance=rng.random(8)))
        taken[got["doc_id"]] += got["copies"]
        assert (got["copies"] <= np.ceil(np.array(rates)[got["doc_id"]])).all()
    assert np.abs(taken / 4000 - rates).max() < 0.03  # four standard errors


def test_the_total_stays_within_a_document():
    rng = np.random.default_rng(2)
    sizes, rates = rng.integers(1, 500, 3000), rng.random(3000) * 3
    for start in rng.random(20):
        got = _pick(_group(sizes, rates, start))
        assert abs((got["n_tokens"] * got["copies"]).sum() - (sizes * rates).sum()) < 500


def test_seeds_take_other_documents_in_the_same_shares(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "'en' as lang", "'t' as text")
    sizes = docs.selectExpr("doc_id", "cast(10 + doc_id % 90 as int) as n_tokens")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    mixes = [mixing.mix_sources(docs, sizes, targets, mixing.MixParams(total_tokens=60_000, seed=s)) for s in (1, 2, 1)]
    taken = [{r["doc_id"] for r in m.documents.collect()} for m in mixes]
    assert taken[0] == taken[2] != taken[1] and any(d % 90 == 89 for d in taken[0])
    for m in mixes[:2]:
        assert all(abs(r["share"] - 0.5) < 0.01 for r in m.shares.collect())


def test_many_targets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 1500) as source", "'en' as lang", "'t' as text")
    sizes = docs.selectExpr("doc_id", "10 as n_tokens")
    targets = spark.range(1500).selectExpr("concat('s', id) as source", "1.0 / 1500 as weight", "1 as max_repeats")
    got = mixing.mix_sources(docs, sizes, targets).shares.filter("documents = 2 and abs(share - 1.0 / 1500) < 1e-6")
    assert got.count() == 1500
