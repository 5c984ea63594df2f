"""Byte-level BPE encoding by numpy merge rounds over many words at once.

The distinct words of a batch lie in one flat array of symbols. In each round the
pairs of all words are looked up by binary search in the sorted pair keys, and
each word merges its pair of lowest rank everywhere it occurs; words without a
known pair leave. Long words, which would need many rounds, look up only what a
merge has changed.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.session import spread

DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte_bpe_50k parts a text before its merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max
_WORDS_KEPT = 400_000
#: Words of more bytes than this are merged by a queue of ranks.
_LONG = 64


def _byte_characters() -> list[str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """byte_ids: id of each byte. keys: sorted left * size + right; ranks and made ids beside them."""

    byte_ids: np.ndarray
    size: int
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray


def load_merges(name: str = "byte_bpe_50k", folder: str | None = None) -> Merges:
    """The tables of a byte-level BPE vocabulary NAME.json; they are of a fixed size, about a megabyte."""
    with open(os.path.join(folder or DEFAULT_TOKENIZERS, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    size = max(vocab.values()) + 1
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return Merges(np.array([vocab[c] for c in _byte_characters()], dtype=np.int64), size, keys[order], order.astype(np.int64), made[order])


def _lookup(merges: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the pairs, _NONE for those that don't merge, and the ids they make."""
    pair = left * merges.size + right
    at = np.minimum(np.searchsorted(merges.keys, pair), len(merges.keys) - 1)
    return np.where(merges.keys[at] == pair, merges.ranks[at], _NONE), merges.made[at]


def _every_second(index: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which of the places to merge: in a run such as aaa the same pair overlaps itself, so every second one of the run."""
    starts = np.maximum.accumulate(np.where(follows, 0, index))
    return (index - starts) % 2 == 0


def encode_long_words(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of each word, in time in proportion to their length.

    Each round merges the pair that has the lowest rank of all, everywhere in the
    flat array; only pairs beside a merge are looked up again. Symbols are linked to
    those before and behind, and places wait in a queue by the rank of their pair.
    """
    n = sum(map(len, words))
    symbols = np.append(merges.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)], 0)
    ends = np.cumsum([len(w) for w in words])
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # n: nothing there
    after[ends - 1] = n
    before[np.concatenate([[0], ends[:-1]])] = n
    after[n] = before[n] = n
    ranks, made = np.full(n + 1, _NONE), np.zeros(n + 1, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def look_up(places: np.ndarray) -> None:
        right = after[places]
        found, new = _lookup(merges, symbols[places], symbols[right])
        found[right == n] = _NONE
        ranks[places], made[places] = found, new
        places, found = places[found != _NONE], found[found != _NONE]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rank = int(found[a])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(queue, rank)
            waiting[rank].append(places[a:b])

    look_up(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        held = waiting.pop(rank)
        places = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        places = places[ranks[places] == rank]
        if len(places) > 1:
            follows = np.append(False, after[places[:-1]] == places[1:])
            places = places[_every_second(np.arange(len(places)), follows)]
        elif not len(places):
            continue
        gone = after[places]
        symbols[places] = made[places]
        ranks[gone], alive[gone] = _NONE, False
        behind = after[gone]
        after[places], before[behind] = behind, places
        after[n] = before[n] = n
        beside = before[places]
        look_up(np.unique(np.concatenate([places, beside[beside != n]])))
    kept = np.flatnonzero(alive)
    return np.split(symbols[kept].astype(np.int32), np.searchsorted(kept, ends[:-1]))


def encode_words(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of each word; in each round every word merges its own pair of lowest rank. Words over _LONG bytes: see encode_long_words."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
    long = [k for k, w in enumerate(words) if len(w) > _LONG]
    if long:
        for k, own in zip(long, encode_long_words([words[k] for k in long], merges), strict=True):
            out[k] = own
        words = [w if len(w) <= _LONG else b"" for w in words]
    symbols = merges.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])

    def finish(symbols: np.ndarray, owner: np.ndarray) -> None:
        cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        for own, k in zip(np.split(symbols.astype(np.int32), cuts), owner[np.concatenate([[0], cuts])].tolist() if len(owner) else [], strict=False):
            out[k] = own

    while len(symbols):
        found, made = _lookup(merges, symbols[:-1], symbols[1:])
        rank = np.append(np.where(owner[:-1] == owner[1:], found, _NONE), _NONE)
        starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        best = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        lowest = np.repeat(best, lengths)
        active = lowest != _NONE
        if not active.all():
            finish(symbols[~active], owner[~active])
        chosen = active & (rank == lowest)
        chosen &= _every_second(np.arange(len(chosen)), chosen & np.append(False, chosen[:-1]))
        symbols = symbols.copy()
        symbols[chosen] = made[chosen[:-1]]
        keep = active & ~np.append(False, chosen[:-1])
        symbols, owner = symbols[keep], owner[keep]
    return out


def encode_texts(texts: pd.Series, merges: Merges, known: dict[str, np.ndarray], pattern: regex.Pattern) -> list[np.ndarray]:
    """The ids of each text; null and empty texts have none. `known` keeps short words that were encoded before."""
    parts = [pattern.findall(t) if t else [] for t in texts]
    new = [w for w in {w for p in parts for w in p} if w not in known]
    known.update(zip(new, encode_words([w.encode() for w in new], merges), strict=True))
    out = [np.concatenate([known[w] for w in p]) if p else np.empty(0, dtype=np.int32) for p in parts]
    for w in new:
        if len(w) > _LONG:
            del known[w]
    if len(known) > _WORDS_KEPT:
        known.clear()
    return out


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, merges: Merges) -> DataFrame:
    """id_col and ids (array of int) of every row; null and empty texts get an empty list.

    Special tokens' strings are ordinary text. Ids may be null or repeated; an empty
    table gives none. There is no shuffle.
    """
    tables = docs.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        pattern = regex.compile(WORD_PATTERN)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                some = batch.iloc[at : at + 2000]
                yield pd.DataFrame({"id": some["id"], "ids": encode_texts(some["text"], tables.value, known, pattern)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInPandas(run, "id string, ids array<int>").select(F.col("id").cast(kind).alias(id_col), "ids")


def token_counts(docs: DataFrame, id_col: str, text_col: str, merges: Merges) -> DataFrame:
    """id_col and n_tokens of every row."""
    return encode_corpus(docs, id_col, text_col, merges).select(id_col, F.size("ids").alias("n_tokens"))
