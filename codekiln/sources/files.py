"""Files and folders as tables, JSON lines, CSV frames and generated pairs."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as source, and folders that are passed over.
SOURCE_GLOB = "*.{c,cc,cpp,cxx,c++}"
IGNORED_FOLDERS = [".git", "node_modules", "build", "dist", ".vscode"]
PAIR_SCHEMA = "name string, category string, subcategory string, unoptimized string, optimized string"


def contained(root: str, path: str) -> str:
    """path under root, normalized; ValueError if it leads out of root."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != posixpath.normpath(root) and not whole.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{path} is outside of {root}")
    return whole


def _relative(root: str) -> Column:
    plain = F.regexp_replace("path", "^file:/+", "/")
    return F.regexp_replace(plain, "^" + "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in posixpath.normpath(root)) + "/", "")


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), code of every source file below root, other than in a build folder. Spark passes over names with . or _ in front."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SOURCE_GLOB).load(root)
    rows = read.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("code"))
    return rows.filter(~F.concat(F.lit("/"), "path").contains("/build/"))


def read_texts(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """path and code of the wanted paths; those that don't exist are empty."""
    return wanted.select("path").join(scan_sources(spark, root), "path", "left").select("path", F.coalesce("code", F.lit("")).alias("code"))


def list_workspace(spark: SparkSession, root: str) -> DataFrame:
    """path, parent, name, is_folder, depth of everything below root but ignored folders; folders from the paths of files, so empty ones are missing."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return tree_of(read.select(_relative(root).alias("path")))


def tree_of(files: DataFrame) -> DataFrame:
    """The same for a table with a column path; both kinds of separator."""
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    kept = files.filter("path is not null").select(parts.alias("parts")).filter(~F.arrays_overlap("parts", F.array(*[F.lit(f) for f in IGNORED_FOLDERS])) & (F.size("parts") > 0))
    rows = kept.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    join = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return rows.select(join(F.col("depth")).alias("path"), join(F.col("depth") - 1).alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") < F.size("parts")).alias("is_folder"), "depth").distinct()


def ordered_listing(tree: DataFrame) -> DataFrame:
    """Folders first, then by name as a person would sort them."""
    return tree.orderBy("parent", F.col("is_folder").desc(), F.collate("name", "UNICODE"), "name")


def detect_projects(files: DataFrame) -> DataFrame:
    """folder, type, source_files, entry_file of every folder of a table with a column path that has CMakeLists.txt or sources."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    rows = files.filter("path is not null").select(path.alias("path")).distinct()
    rows = rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    source = F.lower("name").rlike(r"\.(c|cc|cpp|cxx|c\+\+)$")
    main = F.lower("name").rlike(r"^main\.(c|cc|cpp|cxx|c\+\+)$")
    grouped = rows.groupBy("folder").agg(
        F.max(F.col("name") == "CMakeLists.txt").alias("cmake"),
        F.count_if(source).alias("source_files"),
        F.min_by(F.when(source, F.col("path")), F.when(source, F.struct(~main, F.col("path")))).alias("entry_file"),
    )
    kind = F.when(F.col("cmake"), "cmake").when(F.col("source_files") > 1, "multi-file").otherwise("single-file")
    return grouped.filter(F.col("cmake") | (F.col("source_files") > 0)).select("folder", kind.alias("type"), "source_files", "entry_file")


def read_pair_lines(spark: SparkSession, path: str) -> DataFrame:
    r"""Pairs of JSON lines; objects on one line with a literal \n between them too. What is no object gives no row."""
    lines = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", r"\}\\n\{", "}\u0001{"), "\u0001")).alias("line"))
    parsed = lines.select(F.from_json(F.trim("line"), PAIR_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json(F.trim("line")).alias("v"))
    return parsed.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")).select("x.*")


def write_pair_lines(pairs: DataFrame, path: str) -> None:
    pairs.select(*[c.split()[0] for c in PAIR_SCHEMA.split(", ")]).write.json(path)


def read_frame(spark: SparkSession, path: str, columns: list[str], label: str) -> DataFrame:
    """A training frame of doubles and a label as CSV; a cell that is no number is null."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` double" for c in columns) + f", `{label}` string").csv(path)


def write_frame(frame: DataFrame, path: str) -> None:
    frame.write.option("header", True).csv(path)


#: Pairs that grow from templates: {i} is 1 to 9.
PAIR_TEMPLATES = [
    ("loop", "loop", "code_motion", "for (int k = 0; k < n; k++) {{ s += k * f({i}); }}", "int t = f({i});\nfor (int k = 0; k < n; k++) {{ s += k * t; }}"),
    ("pass", "function", "pass_by_reference", "int g{i}(vector<int> v) {{ return v[{i}]; }}", "int g{i}(const vector<int>& v) {{ return v[{i}]; }}"),
    ("fold", "compiler", "constant_folding", "int c = {i} * 60 * 60;", "constexpr int c = {i} * 3600;"),
]


def generate_pairs(spark: SparkSession) -> DataFrame:
    """Nine pairs from each template."""
    templates = spark.createDataFrame([(*t[:3], t[3].replace("{{", "{").replace("}}", "}"), t[4].replace("{{", "{").replace("}}", "}")) for t in PAIR_TEMPLATES], PAIR_SCHEMA)
    rows = templates.withColumn("i", F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string"))))
    fill = lambda c: F.replace(F.col(c), F.lit("{i}"), F.col("i")).alias(c)
    return rows.select(F.concat("name", F.lit("_"), "i").alias("name"), "category", "subcategory", fill("unoptimized"), fill("optimized"))
