"""Source files that do not parse in the language of their extension.

Texts become token streams, which table-driven parsers made from the bundled
grammars read to the end. A text's first token that can't follow is its error;
there is no recovery, so no later one is reported.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekiln.llm.answers import is_blank
from codekiln.llm.parser_tables import Machine, Tables, bundled_tables
from codekiln.llm.token_streams import ILLEGAL, STREAMS, UNCLOSED
from codekiln.session import spread

# Languages by extension.
EXTENSIONS = {
    "cpp": ["cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h"],
    "python": ["py"],
    "javascript": ["js", "mjs", "cjs"],
}
_SEMICOLONS = {"javascript": (";", "}")}


def language_of(path: Column) -> Column:
    """The language of a path's extension, letter case aside; null for any other."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for language, own in EXTENSIONS.items():
        out = F.when(extension.isin(own), language).otherwise(out)
    return out


def all_tables() -> dict[str, Tables]:
    return {language: bundled_tables(language) for language in EXTENSIONS}


@lru_cache
def machine(language: str) -> Machine:
    """This process's parser of a language."""
    return Machine(bundled_tables(language), *_SEMICOLONS.get(language, (None, "")))


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """Line (from 1) and kind of a text's first error: end (the text stops before it is whole), or token. None if it parses."""
    stream = STREAMS[language](text)
    found = machine(language).parse(stream)
    if found is None:
        return None
    line, at = found
    return line + 1, "end" if _text_stops(stream, line, at) else "token"


def _text_stops(stream: str, line: int, at: int) -> bool:
    """Whether the token at a place of the stream fails because nothing follows, or is a string or comment without an end."""
    lines = stream.split("\n")
    rest = "".join([lines[line][at:], *lines[line + 1 :]])
    return not rest.strip("l^") or rest[0] == UNCLOSED or (rest[0] == ILLEGAL and line == len(stream.rstrip("\nl^").split("\n")) - 1)


def syntax_errors(docs: DataFrame, id_col: str, path_col: str, fields: list[str]) -> DataFrame:
    """id_col, field_name, language, checked, error_line, error_kind of each field of each row, whether it parses or not.

    Blank and invisible texts, null ones and those of paths in no known language are not checked:
    checked is false and the error null. Comments alone parse. Ids may be null or
    repeated; other columns are ignored. There is no shuffle.
    """

    @F.pandas_udf("struct<error_line int, error_kind string>")
    def check(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        found = [first_error(t, x) if t is not None else None for t, x in zip(texts, languages, strict=True)]
        return pd.DataFrame({"error_line": pd.array([f[0] if f else None for f in found], dtype="Int32"), "error_kind": [f[1] if f else None for f in found]})

    own = spread(docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), *[F.col(f).alias(f"text_{k}") for k, f in enumerate(fields)]))
    own = own.select("id", language_of(F.col("path")).alias("language"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"text_{k}").alias("text")) for k, f in enumerate(fields)])).alias("x"))
    checked = F.col("language").isNotNull() & ~is_blank(F.col("x.text"))
    # Taken as nondeterministic, or else a filter on the result would run it a second time below.
    rows = own.select("id", "x.field_name", "language", checked.alias("checked"), check.asNondeterministic()(F.when(checked, F.col("x.text")), F.col("language")).alias("found"))
    return rows.select(F.col("id").alias(id_col), "field_name", "language", "checked", "found.error_line", "found.error_kind")


def error_rates(docs: DataFrame, errors: DataFrame, id_col: str, repo_col: str) -> DataFrame:
    """repo, language, texts, broken, truncated, rate of each repository and language, of the texts checked."""
    repos = docs.select(F.col(id_col), F.col(repo_col).alias("repo"))
    rows = errors.filter("checked").join(repos, id_col)
    grouped = rows.groupBy("repo", "language").agg(F.count("*").alias("texts"), F.count("error_line").alias("broken"), F.sum((F.col("error_kind") == "end").cast("long")).alias("truncated"))
    return grouped.select("repo", "language", "texts", "broken", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.col("broken") / F.col("texts")).alias("rate"))
