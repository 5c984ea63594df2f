"""Records that differ only in appearance, collapsed and counted.

A record's canonical bytes are the letters and digits of its text, case folded.
Tasks first combine equal records of their own input. Buckets of records with a
common prefix of canonical bytes are split by further bytes, again and again, until
each fits or holds one record only; a path-compressed trie with counters at its
terminals then counts each bucket.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.operators.skew import salted_join
from codekiln.session import materialize, spread

_NO_LETTER_OR_DIGIT = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class CollapseParams:
    """bucket_bytes: most canonical bytes of a bucket. combine_bytes: how many a task holds
    to combine its records. first_bytes: width of the first digit; each further one
    doubles the prefix, so even long common beginnings take few rounds."""

    bucket_bytes: int = 16 << 20
    combine_bytes: int = 32 << 20
    first_bytes: int = 4


def canonical_bytes(text: str) -> bytes:
    return _NO_LETTER_OR_DIGIT.sub("", text.casefold()).encode("utf-8", "surrogatepass")


def json_text(raw: str | None, field: str) -> str | None:
    """The text in `field` of raw, if raw is a JSON object and has one."""
    try:
        record = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    value = record.get(field) if isinstance(record, dict) else None
    return value if isinstance(value, str) else None


class Trie:
    """Byte strings with a count and a smallest id each; an edge holds all bytes up to the next fork."""

    __slots__ = ("edge", "forks", "count", "least", "name")

    def __init__(self, edge: bytes = b"") -> None:
        self.edge, self.forks, self.count, self.least, self.name = edge, {}, 0, 0, None

    def add(self, key: bytes, count: int, least: int, name: tuple[int, int]) -> None:
        node, at = self, 0
        while at < len(key):
            child = node.forks.get(key[at])
            if child is None:
                child = node.forks[key[at]] = Trie(key[at:])
            elif not key.startswith(child.edge, at):
                low, high = 1, min(len(child.edge), len(key) - at)
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if key.startswith(child.edge[:middle], at) else (low, middle - 1)
                fork = Trie(child.edge[:low])
                child.edge = child.edge[low:]
                fork.forks[child.edge[0]] = child
                child = node.forks[key[at]] = fork
            node, at = child, at + len(child.edge)
        node.least = least if node.count == 0 else min(node.least, least)
        node.count += count
        node.name = name

    def terminals(self) -> Iterator[tuple[int, int, int, int]]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.count:
                yield (*node.name, node.least, node.count)
            stack.extend(node.forks.values())


def _combined(rows: DataFrame, field: str, params: CollapseParams) -> DataFrame:
    """Rows of two kinds: members (id, name_1, name_2), and records of a task (key, name_1, name_2, id the least, copies)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size = 0

        def records() -> pd.DataFrame:
            table = pd.DataFrame([(k, *v) for k, v in held.items()], columns=["key", "name_1", "name_2", "id", "copies"])
            held.clear()
            return table

        for batch in batches:
            members = []
            for one, raw in zip(batch["id"], batch["raw"], strict=True):
                key = canonical_bytes(json_text(raw, field) or "")
                if not key:
                    continue
                if (own := held.get(key)) is None:
                    names = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), dtype=np.int64)
                    own = held[key] = [int(names[0]), int(names[1]), one, 0]
                    size += len(key)
                own[2], own[3] = min(own[2], one), own[3] + 1
                members.append((own[0], own[1], one))
            out = pd.DataFrame(members, columns=["name_1", "name_2", "id"])
            yield out.assign(key=None, copies=0)[["key", "name_1", "name_2", "id", "copies"]]
            if size > params.combine_bytes:
                yield records()
                size = 0
        yield records()

    return rows.mapInPandas(run, "key binary, name_1 long, name_2 long, id long, copies long")


def radix_buckets(records: DataFrame, params: CollapseParams) -> DataFrame:
    """records with a column bucket, the prefix of key by which they are counted together."""
    opened, closed, width = records, [], params.first_bytes
    while True:
        named = opened.withColumn("bucket", F.substring("key", 1, width))
        sizes = named.groupBy("bucket").agg(F.sum(F.octet_length("key")).alias("bytes"), F.min("name_1").alias("low"), F.max("name_1").alias("high"))
        large = materialize(sizes.filter((F.col("bytes") > params.bucket_bytes) & (F.col("low") < F.col("high"))).select("bucket"), "large-buckets")
        if large.isEmpty():
            closed.append(named)
            break
        closed.append(named.join(large, "bucket", "left_anti"))
        opened = named.join(large, "bucket", "left_semi").drop("bucket")
        width *= 2
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole


@dataclass(frozen=True)
class Collapsed:
    """sets: name_1, name_2, first_id, copies of each distinct record. members: id, name_1, name_2."""

    sets: DataFrame
    members: DataFrame


def collapse_records(rows: DataFrame, id_col: str, raw_col: str, field: str, params: CollapseParams | None = None) -> Collapsed:
    """Sets of records whose texts agree in letters and digits, letter case aside.

    Left out are rows with a null id, a null or broken raw, one that is no JSON
    object, no text in `field`, and texts without a letter or digit. A repeated row
    counts as a copy. An empty table gives empty results; other columns are ignored.
    """
    params = params or CollapseParams()
    plain = spread(rows.select(F.col(id_col).cast("long").alias("id"), F.col(raw_col).alias("raw")).filter("id is not null and raw is not null"))
    both = materialize(_combined(plain, field, params), "canonical")
    placed = radix_buckets(both.filter("key is not null"), params)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["name_1", "name_2", "first_id", "copies"]
        bucket, trie = None, Trie()
        for batch in batches:
            done: list = []
            for at, key, a, b, one, copies in zip(batch["bucket"], batch["key"], batch["name_1"], batch["name_2"], batch["id"], batch["copies"], strict=True):
                if at != bucket:
                    done.extend(trie.terminals())
                    bucket, trie = at, Trie()
                trie.add(key, copies, one, (a, b))
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(list(trie.terminals()), columns=columns)

    together = placed.repartition("bucket").sortWithinPartitions("bucket")
    sets = together.mapInPandas(count, "name_1 long, name_2 long, first_id long, copies long")
    return Collapsed(materialize(sets, "sets"), both.filter("key is null").select("id", "name_1", "name_2"))


def repeats(found: Collapsed) -> DataFrame:
    """line_id_1 (the first of the set) and line_id_2 for each record that repeats an earlier one."""
    several = found.sets.filter("copies > 1").select("name_1", "name_2", "first_id")
    rows = salted_join(found.members, several, ["name_1", "name_2"], "id").filter("id <> first_id")
    return rows.select(F.col("first_id").alias("line_id_1"), F.col("id").alias("line_id_2")).distinct()
