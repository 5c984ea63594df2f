"""Syntax trees from their producers, as tables of nodes (see operators.ast_nodes)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "file_id string, node_id long, parent_id long, ordinal int, depth int, pre long, last long, kind string, spelling string, name string, displayname string, type string, raw string, "
    "loc_file string, line int, column int"
)
_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
_DUMP_LINE = re.compile(r"^([\s|`-]*)([A-Za-z]\w+)\b(.*)$")
_PLACE = re.compile(r"<([^:<>]+:)?(?:line:)?(\d+):(\d+)")


def _location(x: object) -> tuple[str | None, int | None, int | None]:
    if isinstance(x, dict):
        return x.get("file"), x.get("line") if isinstance(x.get("line"), int) else None, x.get("column") if isinstance(x.get("column"), int) else None
    if isinstance(x, str) and (m := re.match(r"^(.+?):(\d+)(?::(\d+))?$", x)):
        return m[1], int(m[2]), int(m[3]) if m[3] else None
    return None, None, None


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def flatten_json(document: str | None, most_depth: int = 60) -> list[dict]:
    """Nodes of one JSON tree in pre-order; none for what is no tree. Nodes deeper than most_depth are left out with what is below them."""
    try:
        root = json.loads(document) if document else None
    except (ValueError, RecursionError):
        return []
    root = root.get("translationUnit", root) if isinstance(root, dict) else None
    if not isinstance(root, dict):
        return []
    rows: list[dict] = []
    stack: list[tuple[dict, int | None, int, int]] = [(root, None, 0, 0)]
    while stack:
        node, parent, ordinal, depth = stack.pop()
        file, line, column = _location(node.get("location"))
        me = len(rows)
        rows.append({"node_id": me, "parent_id": parent, "ordinal": ordinal, "depth": depth, "pre": me, "last": me, "kind": _text(node.get("kind")), "loc_file": file, "line": line, "column": column} | {k: _text(node.get(k)) for k in ("spelling", "name", "displayname", "type", "raw")})
        children = node.get("children")
        if isinstance(children, list) and depth < most_depth:
            stack.extend((c, me, k, depth + 1) for k, c in reversed(list(enumerate(children))) if isinstance(c, dict))
    return _with_last(rows)


def flatten_dump(text: str | None) -> list[dict]:
    """Nodes of a compiler's text dump. Two columns of prefix are one level; a jump of more levels counts as one."""
    rows: list[dict] = []
    open_nodes: list[int] = []
    children: dict[int | None, int] = {}
    for entry in (text or "").splitlines():
        if not (m := _DUMP_LINE.match(entry)):
            continue
        depth = min(len(m[1]) // 2, len(open_nodes))
        del open_nodes[depth:]
        parent = open_nodes[-1] if open_nodes else None
        place = _PLACE.search(m[3])
        me = len(rows)
        rows.append({"node_id": me, "parent_id": parent, "ordinal": children.get(parent, 0), "depth": depth, "pre": me, "last": me, "kind": m[2], "raw": m[3].strip(), "loc_file": place[1].rstrip(":") if place and place[1] else None, "line": int(place[2]) if place else None, "column": int(place[3]) if place else None, "spelling": None, "name": None, "displayname": None, "type": None})
        children[parent] = children.get(parent, 0) + 1
        open_nodes.append(me)
    return _with_last(rows)


def _with_last(rows: list[dict]) -> list[dict]:
    for r in reversed(rows):
        if r["parent_id"] is not None:
            parent = rows[r["parent_id"]]
            parent["last"] = max(parent["last"], r["last"])
    return rows


def flatten_trees(files: DataFrame, key: str, text: str, dump: bool = False, most_depth: int = 60) -> DataFrame:
    """NODE_SCHEMA rows of every file's tree, given as JSON or as a text dump."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, own in zip(batch["file_id"], batch["text"], strict=True):
                rows = flatten_dump(own) if dump else flatten_json(own, most_depth)
                whole = {"parent_id": "Int64", "line": "Int32", "column": "Int32"}
                yield pd.DataFrame({c: pd.Series([one if c == "file_id" else r[c] for r in rows], dtype=whole.get(c, object)) for c in _COLUMNS})

    return files.select(F.col(key).cast("string").alias("file_id"), F.col(text).alias("text")).mapInPandas(run, NODE_SCHEMA)


def main_file_only(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of the file itself and those without a place, not of what it includes; files gives file_id and path."""
    joined = nodes.join(files.select("file_id", "path"), "file_id")
    return joined.filter(F.col("loc_file").isNull() | (F.col("loc_file") == F.col("path")) | F.col("path").endswith(F.concat(F.lit("/"), "loc_file"))).drop("path")


def diagnostics_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, severity, message, line of the diagnostics that a tree's document lists."""
    schema = "diagnostics array<struct<severity int, spelling string, location struct<line int, column int>>>"
    return files.select(key, F.inline(F.from_json(text, schema)["diagnostics"])).select(key, "severity", F.col("spelling").alias("message"), F.col("location.line").alias("line"))
