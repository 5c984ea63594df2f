"""Distinct word shingles of many texts at once, as sorted 64-bit hashes.

Texts of a batch are laid out as one array of code points. Words are runs of
letters, digits and underscores of any script in the lower-cased text; a word's
hash is a difference of running polynomial sums, so no Python object is made for
a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_CHARS_AT_ONCE = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _word_characters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for run in re.finditer(r"\w+", "".join(map(chr, range(0x110000)))):
        table[run.start() : run.end()] = True
    return table


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    factors = np.ones((2, n + 1), dtype=np.uint64)
    factors[:, 1:] = np.array([[_BASE], [inverse]], dtype=np.uint64)
    up, down = np.cumprod(factors, axis=1)
    return up, down


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    inside = np.concatenate([[False], _word_characters()[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(20, int(len(codes)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def _some(texts: list[str], words: int) -> list[np.ndarray]:
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, hashes = _words(codes)
    first = np.cumsum([0] + [len(t) + 1 for t in lowered])
    at = np.searchsorted(starts, first)
    sums = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        sums += hashes[k : k + len(sums)] * np.uint64((2 * k + 3) * _BASE % (1 << 64) | 1)
    sums = mix(sums)
    return [np.unique(sums[a : b - words + 1]) if b - a >= words else sums[:0] for a, b in zip(at[:-1], at[1:], strict=True)]


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """The set of each text, in order; empty for null texts and those of fewer words."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1]) + 1
        if size > _CHARS_AT_ONCE:
            yield from _some(held, words)
            held, size = [], 0
    if held:
        yield from _some(held, words)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of what two sets share and of what either has."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
