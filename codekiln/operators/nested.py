"""Deeply nested analysis documents as flat tables with parent-child links.

A depth-first visitor goes over each document once and emits every record with
the tag of its table, its key, its parent's key and its payload. The emission can
be written partitioned by tag, and each table gets its schema when it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where children are found: tag, path from the document, tag of the children's own suggestions.
CHILD_ARRAYS = [
    ("semantic_issue", ("semanticChecks", "issues"), "semantic_suggestion"),
    ("code_smell", ("codeSmells", "issues"), "smell_suggestion"),
    ("recursive_function", ("features", "recursion", "recursiveFunctions"), None),
    ("time_note", ("complexityEstimate", "time", "notes"), None),
    ("space_note", ("complexityEstimate", "space", "notes"), None),
]
#: The analysis itself; it has no parent, and all records but suggestions have it as theirs.
ROOT = "analysis"
#: Sections that have one record for each analysis: tag, path, what has records or tables of its own.
SECTIONS = [
    ("semantic_checks", ("semanticChecks",), ("issues",)),
    ("code_smells", ("codeSmells",), ("issues",)),
    ("features", ("features",), ("notes",)),
    ("complexity_estimate", ("complexityEstimate",), ("time", "space")),
    ("time_complexity", ("complexityEstimate", "time"), ("notes",)),
    ("space_complexity", ("complexityEstimate", "space"), ("notes",)),
]
CHILD_KINDS = [tag for tag, _, own in CHILD_ARRAYS for tag in ((tag, own) if own else (tag,))]
OLDER_NAMES = {"complexityEstimate": "complexity"}
SECTION_KINDS = [ROOT, *(tag for tag, _, _ in SECTIONS)]

_LOCATION = "location struct<file string, line int, column int>"
#: The schema of each table's payload; `value` is a record that is no object.
TABLE_SCHEMAS = {
    ROOT: "fields map<string, string>",
    "semantic_checks": "scope string",
    "code_smells": "scope string",
    "complexity_estimate": "scope string",
    "features": "scope string, thresholds struct<loops int, nestingDepth int>, loops struct<total int, for int, while int, threshold int, exceedsThreshold boolean>, nesting struct<maxDepth int, threshold int>, "
    "pointers struct<declarations int, dereferences int, addressOf int>, allocations struct<heapNew int, mallocFamily string>, recursion struct<recursiveFunctionCount int>",
    "time_complexity": "bigO string, confidence string, factors map<string, int>",
    "space_complexity": "bigO string, confidence string, factors map<string, int>",
    "semantic_issue": f"issueId string, checkType string, severity string, title string, evidence string, {_LOCATION}, value string",
    "code_smell": f"smellId string, smellType string, severity string, confidence string, title string, evidence string, {_LOCATION}, value string",
    **{tag: "value string" for tag in ("semantic_suggestion", "smell_suggestion", "recursive_function", "time_note", "space_note")},
}

EMISSION = "analysis_id long, table_tag string, record_key string, parent_key string, parent_no int, child_no int, payload string"


def _loads(text: str) -> Any:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _as_object(x: Any) -> dict | None:
    """x if it is an object, or the object that x is the JSON text of."""
    for _ in range(8):
        if isinstance(x, dict) or not isinstance(x, str):
            break
        x = _loads(x)
    return x if isinstance(x, dict) else None


def _at(document: dict, path: tuple[str, ...]) -> Any:
    x: Any = document
    for k, name in enumerate(path):
        if (own := _as_object(x)) is None:
            return None
        x = own.get(name)
        if x is None and k == 0 and name in OLDER_NAMES:
            x = own.get(OLDER_NAMES[name])
    return x


def _elements(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _payload(x: Any, without: tuple[str, ...] = ()) -> str:
    own = _as_object(x)
    return json.dumps({"value": x if isinstance(x, str) else json.dumps(x)} if own is None else {k: v for k, v in own.items() if k not in without}, ensure_ascii=False)


def visit(analysis_id: int, payload: str | None) -> Iterator[tuple]:
    """Rows of EMISSION for one document, depth first; none for a payload that is no JSON object."""
    document = _as_object(payload)
    if document is None:
        return
    root = str(analysis_id)
    in_sections = {path[0] for _, path, _ in SECTIONS} | set(OLDER_NAMES.values())
    yield analysis_id, ROOT, root, None, -1, 0, json.dumps({"fields": {k: v for k, v in document.items() if k not in in_sections}}, ensure_ascii=False)
    for tag, path, without in SECTIONS:
        if (own := _as_object(_at(document, path))) is not None:
            yield analysis_id, tag, f"{root}/{tag}", root, -1, 0, _payload(own, without)
    for tag, path, own_tag in CHILD_ARRAYS:
        for no, child in enumerate(_elements(_at(document, path))):
            if child is None:
                continue
            key = f"{root}/{tag}/{no}"
            yield analysis_id, tag, key, root, -1, no, _payload(child, ("suggestions",))
            if own_tag and (own := _as_object(child)) is not None:
                for k, suggestion in enumerate(_elements(own.get("suggestions"))):
                    if suggestion is not None:
                        yield analysis_id, own_tag, f"{key}/{k}", key, no, k, _payload(suggestion)


def last_received(rows: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """key and payload of each key's row received last; of several at once, the greatest text. Null keys are left out.

    Rows of one key are reduced where they are read, before the shuffle.
    """
    plain = rows.select(F.col(key).cast("long").alias("analysis_id"), F.col(at).alias("at"), F.col(payload).alias("payload")).filter("analysis_id is not null")
    return plain.groupBy("analysis_id").agg(F.max_by("payload", F.struct("at", "payload")).alias("payload"))


def emit_records(rows: DataFrame, key: str = "analysis_id", at: str = "received_at", payload: str = "payload") -> DataFrame:
    """EMISSION rows of the last payload of each analysis.

    A single value in place of an array is an array of one; a null element is no
    record but keeps its position; JSON text in place of an object stands for it. A
    null, empty or broken payload and one that is no object give no rows. An empty
    table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in EMISSION.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for one, text in zip(batch["analysis_id"], batch["payload"], strict=True) for r in visit(one, text)], columns=names)

    return last_received(rows, key, at, payload).mapInPandas(run, EMISSION)


def write_tables(emission: DataFrame, path: str) -> None:
    """Writes the emission once, partitioned by table tag."""
    emission.write.partitionBy("table_tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One flat table of write_tables; only its partition is read."""
    return flat_table(spark.read.parquet(path), tag)


def flat_table(emission: DataFrame, tag: str) -> DataFrame:
    """The records of one tag with the columns of its schema; a field that doesn't fit it is null."""
    own = emission.filter(F.col("table_tag") == tag).withColumn("record", F.from_json("payload", TABLE_SCHEMAS[tag], {"mode": "PERMISSIVE"}))
    return own.select("analysis_id", "record_key", "parent_key", "parent_no", "child_no", "record.*")


def children(emission: DataFrame) -> DataFrame:
    """analysis_id, child_kind, parent_no, child_no of every record of an array."""
    return emission.filter(F.col("table_tag").isin(CHILD_KINDS)).select("analysis_id", F.col("table_tag").alias("child_kind"), "parent_no", "child_no")
