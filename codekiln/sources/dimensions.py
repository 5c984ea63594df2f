"""Small dimension tables: rules, templates, algorithms, error entries.

A user's own come from folders of JSON files, read by Spark; the ones that ship
with the package are read by the driver. Operators meet them page by page.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_ROWS = 5000
_DATA = os.path.join(os.path.dirname(__file__), "data")

RULE_SCHEMA = (
    "id string, category string, title string, rationale string, actions array<string>, references array<string>, priority double, base_confidence double, max_confidence double, stl_signal_weight double, "
    "conditions array<struct<type string, metric_path string, check_type string, smell_type string, operator string, value double, weight double, required boolean, hint string>>, ordinal int"
)
TEMPLATE_SCHEMA = "id string, domain string, priority int, `when` map<string, string>, title string, summary string, actions array<string>, ordinal int"
ALGORITHM_SCHEMA = "name string, keywords array<string>, categories array<string>, ordinal int"
ERROR_SCHEMA = "id string, compiler string, type string, messagePattern string, title string, explanation string, quickFixes array<string>"


def _shipped(spark: SparkSession, name: str, key: str | None, schema: str) -> DataFrame:
    with open(os.path.join(_DATA, f"{name}.json"), encoding="utf-8") as f:
        rows = json.load(f)
    rows = rows[key] if key else rows
    texts = spark.createDataFrame([(json.dumps(r | {"ordinal": k}),) for k, r in enumerate(rows)], "row string")
    return texts.select(F.from_json("row", schema).alias("row")).select("row.*")


def literal_pages(dimension: DataFrame) -> list[Column]:
    """The rows of a dimension in their order as arrays of structs, PAGE_ROWS in each, to be met within the rows of other tables without a join."""
    pages, held = [], []
    kind = f"array<{dimension.schema.simpleString()}>"
    for row in dimension.orderBy("ordinal").toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == PAGE_ROWS:
            pages.append(held)
            held = []
    return [F.from_json(F.lit(json.dumps(page)), kind) for page in [*pages, held] if page]


def _from_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One object or an array of objects in each *.json file; ordinal by file name and place. Files that don't parse give no rows."""
    plain = schema.removesuffix(", ordinal int")
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").schema(plain).json(folder)
    key = plain.split(" ", 1)[0]
    rows = read.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at")).filter(F.col(key).isNotNull())
    place = F.row_number().over(Window.orderBy("__file", "__at")) - 1  # all rows in one task: a dimension is small
    return rows.withColumn("ordinal", place.cast("int")).drop("__file", "__at")


def load_rules(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return _from_files(spark, folder, RULE_SCHEMA) if folder else _shipped(spark, "rules", None, RULE_SCHEMA)


def load_templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        return _shipped(spark, "templates", "templates", TEMPLATE_SCHEMA)
    read = spark.read.option("multiLine", True).schema(f"templates array<struct<{TEMPLATE_SCHEMA.removesuffix(', ordinal int')}>>").json(path)
    return read.select(F.posexplode("templates").alias("ordinal", "x")).select("x.*", "ordinal")


def load_algorithms(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        return _shipped(spark, "algorithms", "algorithms", ALGORITHM_SCHEMA)
    read = spark.read.option("multiLine", True).schema(f"algorithms array<struct<{ALGORITHM_SCHEMA.removesuffix(', ordinal int')}>>").json(path)
    return read.select(F.posexplode("algorithms").alias("ordinal", "x")).select("x.*", "ordinal")


def load_error_entries(spark: SparkSession, folder: str, compiler: str | None = None) -> DataFrame:
    """Entries with a pattern that is a regular expression, in the columns of error_db; of one compiler, if asked for."""
    read = _from_files(spark, folder, f"{ERROR_SCHEMA}, ordinal int")
    rows = read.select("id", "compiler", F.col("type").alias("diag_type"), F.col("messagePattern").alias("message_pattern"), "title", "explanation", F.col("quickFixes").alias("quick_fixes"), "ordinal")
    rows = rows.filter(F.length("message_pattern") > 0)
    return rows.filter(F.col("compiler") == compiler) if compiler else rows
