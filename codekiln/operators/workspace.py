"""Paths of a workspace: renames, removals, upserts, and which open file a message belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekiln.functions.text import unified_path


def _below(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "\\")


def renamed(paths: DataFrame, column: str, old: str, new: str) -> DataFrame:
    r"""The path old and what is below it moved to new; paths with backslashes."""
    path = F.col(column)
    return paths.withColumn(column, F.when(_below(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path))


def removed(paths: DataFrame, column: str, gone: str) -> DataFrame:
    """Without gone and what is below it. Null paths stay."""
    return paths.filter(~F.coalesce(_below(F.col(column), gone), F.lit(False)))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes in place of those of the same keys, or beside them; changes has each key once."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def messages_of_files(messages: DataFrame, files: DataFrame, message_path: str, file_path: str) -> DataFrame:
    """Pairs of messages and files whose paths are equal or where the message's ends in the file's or in its name; letter case and separators aside.

    Joined on the last part of the path, so only files of one name are compared.
    """
    plain = lambda c: F.lower(unified_path(F.col(c)))
    left = messages.withColumn("m", plain(message_path)).withColumn("base", F.element_at(F.split("m", r"\\"), -1))
    right = files.withColumn("f", plain(file_path)).withColumn("base", F.element_at(F.split("f", r"\\"), -1))
    pairs = left.join(right, "base")
    fits = (F.col("m") == F.col("f")) | F.endswith("m", F.concat(F.lit("\\"), "f")) | F.endswith("m", F.concat(F.lit("\\"), "base"))
    return pairs.filter(fits).drop("base", "m", "f")
