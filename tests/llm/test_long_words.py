import random
import time

import pytest

from codekiln.llm.bpe import encode_long_words, encode_words, load_merges


@pytest.fixture(scope="module")
def merges():
    return load_merges()


def _by_hand(word, merges):
    """One merge at a time, the leftmost pair of the lowest rank."""
    table = {int(k): (int(r), int(m)) for k, r, m in zip(merges.keys, merges.ranks, merges.made, strict=True)}
    ids = [int(merges.byte_ids[b]) for b in word]
    while True:
        found = [(*table[ids[k] * merges.size + ids[k + 1]], k) for k in range(len(ids) - 1) if ids[k] * merges.size + ids[k + 1] in table]
        if not found:
            return ids
        _, made, k = min(found, key=lambda x: (x[0], x[2]))
        ids[k : k + 2] = [made]


def test_queue_gives_what_one_merge_at_a_time_gives(merges):
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 160))).encode() for letters in ["abcdefghij", "a", "ab", "theinganors", "漢字仮名交", "ščřжщ", "=-*#"] for _ in range(12)]
    want = [_by_hand(w, merges) for w in words]
    assert [x.tolist() for x in encode_long_words(words, merges)] == want
    assert [x.tolist() for x in encode_words(words, merges)] == want


def test_time_grows_with_the_length(merges):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(320_000)).encode()
    start = time.perf_counter()
    encode_words([word], merges)
    assert time.perf_counter() - start < 2
