"""Sources mixed to target weights by raking, with calibrated sampling.

Documents fall into cells of source, language and topic. Iterative proportional
fitting finds how often a document of each cell is to be used so that sources get
their target shares of the tokens while languages and topics keep the shares they
have in the pool, never above a source's greatest number of repeats. Documents are
then sampled with these rates, in groups of a bounded size: a document of rate 2.3
comes twice, and once more with probability 0.3. The sampling is balanced on tokens
(the cube method with one balancing variable): every document keeps exactly its
probability, and a group's total strays from its expectation by less than a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekiln.session import materialize

#: What the languages of documents may be; others count as one.
LANGUAGES = ["en", "de", "fr", "es", "ru", "zh", "ja", "hi", "th", "ar"]


@dataclass(frozen=True)
class MixParams:
    """total_tokens: size of the mix; null for the largest that meets every source's weight.
    sweeps: rounds of fitting. group_rows: documents that one sampling task orders.
    seed: of the random starts; the same seed gives the same documents."""

    total_tokens: int | None = None
    sweeps: int = 200
    group_rows: int = 50_000
    seed: int = 0


def topic_of(text: Column) -> Column:
    """A document's topic by what it shows: code, diagnostic, measurement, list or prose."""
    return (
        F.when(text.contains("```"), "code")
        .when(text.rlike(r"(?m):\d+:\d+:\s*(warning|error)"), "diagnostic")
        .when(text.rlike(r"\d\s?(ms|KB|MB|%)"), "measurement")
        .when(text.rlike(r"(?m)^\s*([-*]|\d+[.)])\s"), "list")
        .otherwise("prose")
    )


def rake(cells: list[tuple[str, str, str, float]], wanted: dict[str, float], caps: dict[str, float], sweeps: int) -> dict[tuple[str, str, str], float]:
    """How often a document of each cell is used. cells: (source, language, topic, tokens); wanted: tokens of each source.

    Languages and topics are fitted first in each sweep and sources last, so the
    sources' margins are met. Cells at their cap stay there and the others of the
    source make up for it.
    """
    tokens = np.array([c[3] for c in cells], dtype=float)
    cap = np.array([caps[c[0]] for c in cells], dtype=float)
    margins = []
    total = sum(wanted.values())
    for k in (1, 2, 0):
        names = sorted({c[k] for c in cells})
        place = {name: at for at, name in enumerate(names)}
        own = np.array([place[c[k]] for c in cells])
        have = np.bincount(own, tokens, len(names))
        margins.append((own, np.array([wanted[n] for n in names]) if k == 0 else have / max(have.sum(), 1) * total))
    rates = np.minimum(1.0, cap)
    for _ in range(sweeps):
        for own, target in margins:
            now = np.bincount(own, tokens * rates, len(target))
            rates = np.minimum(cap, rates * np.where(now > 0, target / np.maximum(now, 1e-12), 1.0)[own])
    own, target = margins[-1]
    for _ in range(50):  # fill up what caps took away, within each source
        now = np.bincount(own, tokens * rates, len(target))
        room = np.bincount(own, tokens * (cap - rates), len(target))
        share = np.clip((target - now) / np.maximum(room, 1e-12), 0, 1)[own]
        rates = np.where((now > target)[own], rates * (target / np.maximum(now, 1e-12))[own], rates + (cap - rates) * share)
    return {c[:3]: float(r) for c, r in zip(cells, rates, strict=True)}


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, source, n_tokens, copies (1 or more). shares: a row for each target source."""

    documents: DataFrame
    shares: DataFrame


def mix_sources(docs: DataFrame, sizes: DataFrame, targets: DataFrame, params: MixParams | None = None) -> Mix:
    """docs (doc_id, source, lang, text) and sizes (doc_id, n_tokens) mixed to targets (source, weight, max_repeats).

    Weights count among the target sources that have tokens; a source without any
    gets none and is reported with a share of 0. Documents of other sources, with
    null ids or without tokens are not used, repeated ones once; a null language is one of its own. Rows
    of targets with a null source, weight or max_repeats, or not above 0, want nothing.
    The number of cells, which are fitted on the driver, is at most 60 for each target
    that wants something, whatever docs holds.
    """
    params = params or MixParams()
    plan = targets.select(F.col("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanting = plan.filter("source is not null and weight > 0 and max_repeats > 0")
    asked = {r["source"]: (r["weight"], r["max_repeats"]) for r in wanting.orderBy("source", "weight", "max_repeats").toLocalIterator()}
    lang = F.lower(F.trim("lang"))
    language = F.when(lang.isin(LANGUAGES), lang).when(lang.isNull(), "unknown").otherwise("other")
    pool = docs.filter(F.col("doc_id").isNotNull()).join(wanting.select("source").distinct(), "source", "left_semi")
    pool = pool.select("doc_id", "source", language.alias("language"), F.coalesce(topic_of(F.col("text")), F.lit("prose")).alias("topic"))
    pool = materialize(pool.dropDuplicates(["doc_id"]).join(sizes.filter("n_tokens > 0").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "doc_id"), "pool")
    cells = [tuple(r) for r in pool.groupBy("source", "language", "topic").agg(F.sum("n_tokens").cast("double")).orderBy("source", "language", "topic").toLocalIterator()]

    have: dict[str, float] = {}
    for source, _, _, tokens in cells:
        have[source] = have.get(source, 0.0) + tokens
    weights = {s: asked[s][0] for s in have}
    sum_weights = sum(weights.values()) or 1.0
    most = min((have[s] * asked[s][1] * sum_weights / weights[s] for s in have), default=0.0)
    total = most if params.total_tokens is None else float(params.total_tokens)
    wanted = {s: min(total * w / sum_weights, have[s] * asked[s][1]) for s, w in weights.items()}
    rates = rake(cells, wanted, {s: float(asked[s][1]) for s in have}, params.sweeps) if cells else {}

    spark = docs.sparkSession
    table = spark.createDataFrame([(*k, v) for k, v in rates.items()], "source string, language string, topic string, rate double")
    groups = pool.groupBy("source").agg(F.ceil(F.count("*") / params.group_rows).cast("int").alias("groups"))
    rated = pool.join(table, ["source", "language", "topic"]).join(groups, "source")
    part = F.pmod(F.xxhash64("doc_id"), "groups")
    draw = lambda *of: (F.pmod(F.xxhash64(*of, F.lit(params.seed)), F.lit(1 << 40)) / float(1 << 40))
    rated = rated.select("doc_id", "source", "n_tokens", "rate", part.alias("part"), draw(F.col("doc_id"), F.lit("order")).alias("draw"), draw(F.col("doc_id"), F.lit("taken")).alias("chance"), draw(F.col("source"), part, F.lit("start")).alias("start"))
    picked = rated.groupBy("source", "part").applyInPandas(_pick, "doc_id long, source string, n_tokens long, copies int")
    chosen = materialize(picked, "mix")
    return Mix(chosen, _reached(chosen, plan))


def _pick(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of one group with their copies: the whole part of the rate, and one more with the probability of what is left.

    Probabilities are settled two documents at a time, large ones first: what one
    gains in tokens the other loses, until one of them is sure to be taken or left,
    and chance decides which way, so that each keeps its probability. All that is
    not settled in the end is one document, so the group's total strays by less.
    """
    group = group.sort_values(["n_tokens", "draw", "doc_id"], ascending=[False, True, True])
    rates = group["rate"].to_numpy()
    whole = np.floor(rates + 1e-9)
    extra = np.clip(rates - whole, 0, 1)
    copies, sizes, chances, draws = whole.astype(int), group["n_tokens"].to_numpy().tolist(), extra.tolist(), group["chance"].to_numpy().tolist()
    held = -1
    for k, p in enumerate(chances):
        if p < 1e-9:
            continue
        if held < 0:
            held = k
            continue
        q, a, b = chances[held], sizes[held], sizes[k]
        up, down = min((1 - q) * a, p * b), min(q * a, (1 - p) * b)  # tokens that may move to the one held, or from it
        move = up if draws[k] * (up + down) < down else -down
        q, p = q + move / a, p - move / b
        chances[held], chances[k] = q, p
        if 1e-9 < p < 1 - 1e-9:
            copies[held] += q > 0.5
            held = k
        else:
            copies[k] += p > 0.5
            if not 1e-9 < q < 1 - 1e-9:
                copies[held] += q > 0.5
                held = -1
    if held >= 0:
        copies[held] += group["start"].iloc[0] < chances[held]
    out = group[["doc_id", "source", "n_tokens"]].assign(copies=copies.astype(np.int32))
    return out[out["copies"] > 0]


def _reached(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """source, weight, max_repeats, documents, tokens, most_copies, share of each row of the plan."""
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    all_tokens = used.agg(F.sum("tokens")).first()[0] or 1
    none = F.lit(0)
    return plan.join(used, "source", "left").select(
        "source",
        "weight",
        "max_repeats",
        F.coalesce("documents", none).alias("documents"),
        F.coalesce("tokens", none).alias("tokens"),
        F.coalesce("most_copies", none).alias("most_copies"),
        (F.coalesce("tokens", none) / all_tokens).alias("share"),
    )
