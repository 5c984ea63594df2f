"""Requests as JSON: what is wrong with them, and lists of arguments merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """kind: text, whole, flag, texts or object. low, high: of whole numbers. values: all that a text may be."""

    kind: str
    required: bool = False
    low: int = 0
    high: int = 0
    values: tuple[str, ...] = ()
    filled: bool = False


_PATH = Field("text", filled=True)
_NEEDED = Field("text", required=True, filled=True)
_COMPILER = Field("text", values=("clang++", "g++"))
# The fields that requests may have, and their ranges.
REQUESTS = {
    "compile": {
        "compiler": _COMPILER,
        "sourcePath": _PATH,
        "outputPath": _PATH,
        "extraArgs": Field("texts"),
        "code": Field("text"),
        "projectType": Field("text", values=("single-file", "multi-file", "cmake")),
        "sourceFiles": Field("texts"),
        "projectRootPath": _PATH,
        "buildPath": _PATH,
    },
    "run": {"binaryPath": _PATH, "args": Field("texts")},
    "analyze": {"scriptPath": _PATH, "sourcePath": _PATH, "args": Field("texts")},
    "complexity": {"sourcePath": _PATH, "code": Field("text"), "args": Field("texts")},
    "benchmark": {
        "compiler": _COMPILER,
        "sourcePath": _PATH,
        "outputPath": _PATH,
        "extraArgs": Field("texts"),
        "code": Field("text"),
        "args": Field("texts"),
        "runs": Field("whole", low=1, high=50),
        "warmupRuns": Field("whole", low=0, high=10),
    },
    "simulate": {"language": Field("text", values=("cpp",)), "sourcePath": _PATH, "code": Field("text"), "maxLoopIterations": Field("whole", low=1, high=200)},
    "optimize": {"sourcePath": _PATH, "code": Field("text"), "skipMl": Field("flag")},
    "compare": {"benchmarkResult": Field("object", required=True)},
    "history": {"limit": Field("whole", low=1, high=50)},
    "list": {"targetPath": Field("text")},
    "create": {"targetPath": _NEEDED, "kind": Field("text", required=True, values=("file", "directory"))},
    "rename": {"targetPath": _NEEDED, "nextPath": _NEEDED},
}
_SHOWN = {"text": "STRING", "flag": "BOOLEAN", "texts": "ARRAY<STRING>", "whole": "BIGINT"}


def _problem(request: Column, name: str, field: Field) -> Column:
    """What is wrong with one field, or null."""
    path = f"$.{name}"
    value = F.try_variant_get(request, path, "variant")
    shown = F.schema_of_variant(value)
    given = F.coalesce(shown, F.lit("")) != ""
    if field.kind == "whole":
        number = F.try_variant_get(request, path, "double")
        right = (shown.startswith("BIGINT") | shown.startswith("DECIMAL") | shown.startswith("DOUBLE")) & (number == F.floor(number))
        inside = (number >= field.low) & (number <= field.high)
    elif field.kind == "object":
        right, inside = shown.startswith("OBJECT"), F.lit(True)
    else:
        right = shown == _SHOWN[field.kind]
        if field.kind == "texts":
            right = right | (shown == "ARRAY<VOID>") & (F.try_variant_get(request, path, "array<string>") == F.array().cast("array<string>"))
        text = F.try_variant_get(request, path, "string")
        inside = text.isin(list(field.values)) if field.values else (text != "") if field.filled else F.lit(True)
    missing = F.lit(f"{name}: missing") if field.required else F.lit(None).cast("string")
    return F.when(~given, missing).when(~F.coalesce(right, F.lit(False)), f"{name}: of another kind").when(~F.coalesce(inside, F.lit(False)), f"{name}: out of range")


def request_problems(payload: Column, kind: str) -> Column:
    """What is wrong with a request of a kind of REQUESTS, in order of names; an empty array for a good one.

    A request is a JSON object of no other fields than those of its kind. Anything
    else, null included, has the one problem of being no object.
    """
    fields = REQUESTS[kind]
    request = F.try_parse_json(payload)
    unknown = F.transform(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(": unknown")))
    own = F.filter(F.array(*[_problem(request, name, f) for name, f in fields.items()]), lambda p: p.isNotNull())
    whole = F.coalesce(F.schema_of_variant(request), F.lit("")).startswith("OBJECT")
    return F.when(whole, F.array_sort(F.concat(unknown, own))).otherwise(F.array(F.lit("no object")))


def checked_requests(requests: DataFrame, payload: str, kind: str) -> DataFrame:
    """requests with problems; see request_problems."""
    return requests.withColumn("problems", request_problems(F.col(payload), kind))


def merged_arguments(first: list[str], given: Column) -> Column:
    """first, then what is given, each argument once where it first stands; null counts as none given."""
    none = F.array().cast("array<string>")
    return F.array_union(F.array(*map(F.lit, first)) if first else none, F.coalesce(given, none))
