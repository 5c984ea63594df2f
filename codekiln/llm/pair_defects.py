"""Defective prompt and response pairs, from labels of the response's clauses.

A conditional random field labels each clause as answer, refusal, echo, foreign or
unfinished. The share of the text that each label covers decides the pair's
defect; copies and truncated programs are then checked exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.llm.answers import is_blank, is_empty_answer
from codekiln.llm.clauses import ANSWER, ECHO, FOREIGN, REFUSAL, UNFINISHED, Described, described, label_clauses, squeezed, trained_field
from codekiln.llm.crf import Field
from codekiln.session import spread

_AT_ONCE = 200


def _defect(prompt: str, response: str, made: Described, labels: np.ndarray) -> str | None:
    sizes = np.array([len(c.text) for c in made.clauses], dtype=float)
    cover = np.bincount(labels, sizes, 5) / max(sizes.sum(), 1)
    code = any(c.kind == "code" for c in made.clauses)
    if cover[REFUSAL] >= 0.3 and not code:
        return "refusal"
    if cover[FOREIGN] >= 0.5:
        return "other_language"
    if cover[ECHO] + cover[UNFINISHED] > cover[ANSWER] and squeezed(prompt, made.spoken) == squeezed(response, made.spoken):
        return "copy"
    return "truncated" if cover[UNFINISHED] > 0 else None


def defects_of(prompts: list[str], responses: list[str], field: Field) -> list[str | None]:
    """The defect of each pair of texts, or None."""
    made = [described(p, r) for p, r in zip(prompts, responses, strict=True)]
    labels = label_clauses(field, made)
    return [_defect(p, r, m, own) if len(own) else None for p, r, m, own in zip(prompts, responses, made, labels, strict=True)]


def pair_defects(pairs: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    """id_col and defect of every pair with a prompt: the first that holds of empty, refusal, other_language, copy, truncated, or null.

    Pairs whose prompt is null or blank are left out. Empty answers never leave the
    JVM. Ids may be null or repeated; other columns are ignored. There is no shuffle.
    """
    field = trained_field()

    @F.pandas_udf("string")
    def judge(prompts: pd.Series, responses: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(prompts)
        asked = [k for k, r in enumerate(responses) if r is not None]
        for at in range(0, len(asked), _AT_ONCE):
            some = asked[at : at + _AT_ONCE]
            for k, found in zip(some, defects_of([prompts[k] for k in some], [responses[k] for k in some], field), strict=True):
                out[k] = found
        return pd.Series(out, dtype=object)

    rows = spread(pairs.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"))).filter(~is_blank(F.col("prompt")))
    rows = rows.withColumn("empty", is_empty_answer(F.col("response")))
    # Taken as nondeterministic, or else a filter on the result would run it a second time below.
    said = judge.asNondeterministic()("prompt", F.when(~F.col("empty"), F.col("response")))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("empty"), "empty").otherwise(said).alias("defect"))
