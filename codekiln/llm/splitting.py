"""Oversized texts cut into overlapping pieces at natural boundaries, by pointer doubling.

Every boundary of a text points to its farthest legal successor: where the piece
that starts an overlap before it may end. Squaring that table (successor of the
successor, and so on) reaches all greedy cuts of all texts of a batch in as many
rounds as the largest number of pieces has binary digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of boundaries, in which the strongest within reach wins.
_CHARACTER, _LINE, _PARAGRAPH, _DEFINITION = range(4)
_BYTES_AT_ONCE = 8_000_000


@dataclass(frozen=True)
class SplitParams:
    """Sizes in bytes of UTF-8. A boundary of a higher rank is taken before a farther one of
    a lower rank if the piece then has at least `least_share` of what it may add."""

    limit: int = 3000
    overlap: int = 200
    least_share: float = 0.5


def boundaries(body: np.ndarray, params: SplitParams) -> tuple[np.ndarray, np.ndarray]:
    """Positions where one text may be cut, ends included, in order, and their ranks.

    Lines are boundaries; after a blank line more so, and most where a line without
    indent that closes nothing follows. Between lines too far apart come the places
    after white space and separators, and where those are too far apart, characters.
    """
    n = len(body)
    starts = np.flatnonzero(body == 10) + 1
    starts = starts[starts < n]
    solid = np.concatenate([[0], np.cumsum(body > 32)])
    before = np.concatenate([[0], starts[:-1]])[: len(starts)]
    blank = solid[starts] == solid[before]
    own = body[starts]
    top = blank & (own > 32) & ~np.isin(own, np.frombuffer(b")}]", dtype=np.uint8))
    ranks = np.where(top, _DEFINITION, np.where(blank, _PARAGRAPH, _LINE))
    at = np.concatenate([[0], starts, [n]])
    ranks = np.concatenate([[_DEFINITION], ranks, [_DEFINITION]])
    reach = params.limit - params.overlap
    for finer in (np.flatnonzero(np.isin(body, np.frombuffer(b" \t;,", dtype=np.uint8))) + 1, np.flatnonzero((body & 0xC0) != 0x80)):
        wide = np.flatnonzero(np.diff(at) > reach)
        if not len(wide):
            break
        slot = np.searchsorted(at, finer, "right") - 1
        new = finer[np.isin(slot, wide) & (finer < n) & ~np.isin(finer, at)]
        order = np.argsort(at := np.concatenate([at, new]), kind="stable")
        at, ranks = at[order], np.concatenate([ranks, np.full(len(new), _CHARACTER)])[order]
    return at, ranks


def pieces_of(bodies: list[bytes], params: SplitParams) -> list[np.ndarray]:
    """For each text an array of (start, end) of its pieces."""
    if not bodies:
        return []
    whole = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    begins = ends - [len(b) for b in bodies]
    found = [boundaries(whole[a:b], params) for a, b in zip(begins, ends, strict=True)]
    # A text's last boundary and the next one's first are at the same place, but two entries.
    at = np.concatenate([x + a for (x, _), a in zip(found, begins, strict=True)])
    ranks = np.concatenate([r for _, r in found])
    counts = np.array([len(x) for x, _ in found])
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    end_of = np.repeat(last, counts)
    start = np.maximum(at - params.overlap, at[np.repeat(first, counts)])
    for _ in range(3):  # a character has at most three more bytes
        start += (start < at) & ((whole[np.minimum(start, len(whole) - 1)] & 0xC0) == 0x80)
    index = np.arange(len(at))
    limit = np.minimum(np.minimum(np.searchsorted(at, start + params.limit, "right") - 1, end_of), len(at) - 1)
    legal = np.maximum(at + 1, start + params.overlap)  # a text's first piece must hold the overlap of the second
    fill = at + (start + params.limit - at) * params.least_share
    successor = limit.copy()
    for rank in (_LINE, _PARAGRAPH, _DEFINITION):
        farthest = np.maximum.accumulate(np.where(ranks >= rank, index, 0))[limit]
        successor = np.where((farthest > index) & (at[farthest] >= (legal if rank == _LINE else fill)), farthest, successor)
    successor = np.where(limit == end_of, end_of, successor)
    reached, jump = first, successor
    while True:
        more = np.union1d(reached, jump[reached])
        if len(more) == len(reached):
            break
        reached, jump = more, jump[jump]
    out = []
    for a, f, z in zip(begins, first, last, strict=True):
        own = reached[np.searchsorted(reached, f) : np.searchsorted(reached, z, "right")]
        out.append(np.stack([start[own[:-1]] - a, at[own[1:]] - a], axis=1))
    return out


def split_texts(docs: DataFrame, id_col: str, fields: list[str], params: SplitParams | None = None) -> DataFrame:
    """id_col, field_name, piece_no, pieces, start_byte, end_byte, piece for each field of each row.

    No piece is over the limit. Each but a text's first starts with the overlap of the
    one before; without that much of each, the pieces give the text again. Texts
    within the limit and empty ones are one piece and never leave the JVM; null texts
    have none. Ids may be null or repeated; other columns are ignored.
    """
    params = params or SplitParams()
    if not params.limit > params.overlap + 4 >= 4:
        raise ValueError("the limit must exceed the overlap by more than a character")

    @F.pandas_udf("array<struct<start_byte int, end_byte int>>")
    def cut(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        held: list[tuple[int, bytes]] = []

        def flush() -> None:
            for (k, _), found in zip(held, pieces_of([b for _, b in held], params), strict=True):
                out[k] = [{"start_byte": int(a), "end_byte": int(b)} for a, b in found]
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            if text is not None:
                held.append((k, text.encode()))
                size += len(held[-1][1])
                if size > _BYTES_AT_ONCE:
                    flush()
                    size = 0
        flush()
        return pd.Series(out)

    own = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select("id", "x.*")
    long = F.octet_length("text") > params.limit
    whole = F.array(F.struct(F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte")))
    # Taken as nondeterministic, or else a filter on the result would run it a second time below.
    cuts = own.filter("text is not null").withColumn("cuts", cut.asNondeterministic()(F.when(long, F.col("text"))))
    rows = cuts.select("id", "field_name", "text", F.coalesce("cuts", whole).alias("cuts"))
    rows = rows.select("id", "field_name", "text", F.size("cuts").alias("pieces"), F.posexplode("cuts").alias("piece_no", "cut"))
    piece = F.expr("cast(substring(cast(text as binary), cut.start_byte + 1, cut.end_byte - cut.start_byte) as string)")
    return rows.select(F.col("id").alias(id_col), "field_name", "piece_no", "pieces", "cut.start_byte", "cut.end_byte", piece.alias("piece"))
