"""Syntax trees as tables: metrics, semantic checks and code smells of many files at once.

A tree is a table of nodes: file_id, node_id, parent_id, ordinal (among siblings),
depth, pre (place in pre-order) and last (pre of the last descendant, its own for a
leaf), kind, spelling, name, displayname, type, raw, line. A subtree is the range
pre..last, so that ancestors and descendants are questions of order: they are
answered by running counts over each file's nodes, never by pairing nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.functions.score import big_o_rank, big_o_rank_extended, space_complexity, time_complexity
from codekiln.functions.text import ascii_word

# Kinds of nodes.
FUNCTIONS = ["FUNCTION_DECL", "CXX_METHOD", "FUNCTIONTEMPLATE", "CONSTRUCTOR", "DESTRUCTOR"]
CALLS = ["CALL_EXPR", "CXXMEMBERCALL_EXPR", "CXX_OPERATOR_CALL_EXPR"]
CONTROLS = ["IF_STMT", "SWITCH_STMT", "FOR_STMT", "WHILE_STMT", "DO_STMT", "CXX_FOR_RANGE_STMT"]
TERMINATORS = ["RETURN_STMT", "BREAK_STMT", "CONTINUE_STMT", "CXX_THROW_EXPR", "GOTO_STMT"]
NOT_EXECUTED = ["NULL_STMT", "DECL_STMT", "VAR_DECL", "PARM_DECL", "TYPE_REF", "NAMESPACE_REF", "TEMPLATE_REF", "TYPEDEF_DECL"]
MEMBERS = ["FIELD_DECL", "CXX_METHOD", "CONSTRUCTOR", "DESTRUCTOR", "VAR_DECL"]
COUNTED = ["CALL_EXPR", "CXXMEMBERCALL_EXPR", "CXX_OPERATOR_CALL_EXPR", "BINARY_OPERATOR", "UNARY_OPERATOR", "CXX_NEW_EXPR", "CXX_DELETE_EXPR"]
CONTAINERS = [f"std::{x}" for x in "vector string map set unordered_map unordered_set list deque array queue stack priority_queue".split()]
ALGORITHMS = [f"std::{x}" for x in "sort find transform for_each accumulate lower_bound upper_bound remove copy count".split()]
# More than these is too much.
THRESHOLDS = {"loops": 8, "nesting": 4, "recursion": 0, "pointers": 10, "stl": 12, "allocations": 6, "long_function": 20, "deep_nesting": 4, "large_class": 12, "magic_numbers": 4, "duplicate_blocks": 1}


def normalized_kind(kind: Column, strict_compat: bool = False) -> Column:
    """A kind without its prefix, in capitals. Kinds of text dumps (ForStmt) get their underscores, unless compatibility is asked for."""
    plain = F.when(kind.rlike(r"CursorKind\.[A-Z_]+"), F.regexp_extract(kind, r"CursorKind\.([A-Z_]+)", 1))
    if not strict_compat:
        spaced = F.regexp_replace(F.regexp_replace(kind, "([a-z0-9])([A-Z])", "$1_$2"), "^(CXX)([A-Z])", "$1_$2")
        plain = plain.when(kind.rlike("[a-z]"), F.upper(F.regexp_replace(spaced, "[^A-Za-z0-9_]", "_")))
    return F.coalesce(plain.otherwise(F.upper(F.regexp_replace(kind, "[^A-Za-z0-9_]", "_"))), F.lit(""))


def label_of(node: list[str] | None = None) -> Column:
    """All the texts of a node, in small letters."""
    return F.lower(F.concat_ws(" ", *(node or ["name", "spelling", "displayname", "raw", "type"])))


def identifier_of() -> Column:
    """Spelling, else name, else the display name up to its bracket; null if all are blank."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(F.col("spelling")), some(F.col("name")), some(F.split(F.trim("displayname"), r"\(")[0]))


def prepared(nodes: DataFrame, strict_compat: bool = False) -> DataFrame:
    """nodes with kind normalized, and label and identifier."""
    missing = [c for c in ("name", "spelling", "displayname", "raw", "type") if c not in nodes.columns]
    nodes = nodes.withColumns({c: F.lit(None).cast("string") for c in missing})
    return nodes.withColumns({"kind": normalized_kind(F.col("kind"), strict_compat), "label": label_of(), "identifier": identifier_of()})


def _has(names: list[str], text: Column) -> Column:
    """How many of the names the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in names])


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("int")), F.lit(0))


def node_metrics(nodes: DataFrame) -> DataFrame:
    """Counts of loops, pointers, library use, allocations and imbalances of each file, in one aggregation."""
    label, kind_type = F.col("label"), F.lower(F.coalesce("type", F.lit("")))
    operators = _is("UNARY_OPERATOR", "CXX_OPERATOR_CALL_EXPR")
    call = _is("CALL_EXPR")
    counted = nodes.groupBy("file_id").agg(
        _sum(_is("FOR_STMT")).alias("loops_for"),
        _sum(_is("WHILE_STMT")).alias("loops_while"),
        _sum(_is("DO_STMT")).alias("loops_do_while"),
        _sum(_is("CXX_FOR_RANGE_STMT")).alias("loops_range_for"),
        F.countDistinct(F.when(_is(*FUNCTIONS), F.col("identifier"))).alias("function_count"),
        _sum(_is("VAR_DECL", "PARM_DECL", "FIELD_DECL") & (label.contains("*") | kind_type.contains("*"))).alias("pointers_declarations"),
        F.coalesce(F.sum((operators & (label.contains("operator*") | label.rlike(r"\s\*"))).cast("int") + label.contains("->").cast("int")), F.lit(0)).alias("pointers_dereferences"),
        _sum(operators & (label.contains("operator&") | label.rlike(r"\s&"))).alias("pointers_address_of"),
        F.coalesce(F.sum(_has(CONTAINERS, label)), F.lit(0)).alias("stl_container_refs"),
        F.coalesce(F.sum(_has(ALGORITHMS, label)), F.lit(0)).alias("stl_algorithm_calls"),
        _sum(label.contains("iterator")).alias("stl_iterator_usage"),
        _sum(_is("CXX_NEW_EXPR")).alias("alloc_heap_new"),
        _sum(_is("CXX_DELETE_EXPR")).alias("alloc_heap_delete"),
        _sum(call & label.rlike(ascii_word("malloc|calloc|realloc"))).alias("alloc_malloc_family"),
        _sum(call & label.rlike(ascii_word("free"))).alias("alloc_free_calls"),
        _sum(_is("VAR_DECL") & (kind_type.contains("[") | label.rlike(r"\[[^\]]+\]"))).alias("alloc_stack_arrays"),
    )
    total = lambda *names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return counted.withColumns(
        {
            "loops_total": total("loops_for", "loops_while", "loops_do_while", "loops_range_for"),
            "pointers_total": total("pointers_declarations", "pointers_dereferences", "pointers_address_of"),
            "stl_total": total("stl_container_refs", "stl_algorithm_calls", "stl_iterator_usage"),
            "alloc_total": total("alloc_heap_new", "alloc_heap_delete", "alloc_malloc_family", "alloc_free_calls", "alloc_stack_arrays"),
        }
    )


def nesting_depth(nodes: DataFrame) -> DataFrame:
    """file_id, nesting_max_depth: most control nodes open at once; 0 for files without any.

    A control node opens at its place and closes behind its last descendant; the
    depth is a running sum over both.
    """
    control = nodes.filter(_is(*CONTROLS)).select("file_id", "pre", "last")
    steps = control.select("file_id", F.explode(F.array(F.struct((F.col("pre") * 2).alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") * 2 + 1).alias("at"), F.lit(-1).alias("step")))).alias("x"))
    # Closings of one place belong together, so they count as one step.
    merged = steps.groupBy("file_id", "x.at").agg(F.sum("x.step").alias("step"))
    running = merged.withColumn("open", F.sum("step").over(Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    deepest = running.groupBy("file_id").agg(F.max("open").cast("int").alias("depth"))
    return nodes.select("file_id").distinct().join(deepest, "file_id", "left").select("file_id", F.coalesce("depth", F.lit(0)).alias("nesting_max_depth"))


def recursive_calls(nodes: DataFrame) -> DataFrame:
    """file_id, identifier, node_id of each call of the function that most closely surrounds it.

    A running sum over where functions open and close tells how many are open at a
    call; the innermost is the last one that opened at that depth. One shuffle by file.
    """
    at, opens, closes = F.col("pre") * 2, _is(*FUNCTIONS), F.col("last") * 2 + 1
    own = nodes.filter(_is(*FUNCTIONS, *CALLS)).select("file_id", "node_id", "identifier", "pre", "last", "kind")
    enter = F.struct(at.alias("at"), F.lit(1).alias("step"), F.col("identifier").alias("name"), F.lit(None).cast("string").alias("called"))
    leave = F.struct(closes.alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("called"))
    call = F.struct(at.alias("at"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("name"), F.col("identifier").alias("called"))
    events = own.select("file_id", "node_id", F.explode(F.when(opens, F.array(enter, leave)).otherwise(F.array(call))).alias("x")).select("file_id", "node_id", "x.*")
    upto = Window.partitionBy("file_id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("open", F.sum("step").over(upto)).filter("step >= 0 and open > 0")
    same_depth = Window.partitionBy("file_id", "open").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # A function without a name still hides those around it.
    inner = F.last(F.when(F.col("step") == 1, F.struct("name")), ignorenulls=True).over(same_depth)
    found = deep.withColumn("owner", inner).filter((F.col("step") == 0) & (F.col("owner.name") == F.col("called")))
    return found.select("file_id", F.col("called").alias("identifier"), "node_id")


def recursion_metrics(nodes: DataFrame) -> DataFrame:
    """file_id, recursion_count, recursive_functions (in order) of files that have some."""
    return recursive_calls(nodes).groupBy("file_id").agg(F.countDistinct("identifier").alias("recursion_count"), F.sort_array(F.collect_set("identifier")).alias("recursive_functions"))


def file_features(nodes: DataFrame) -> DataFrame:
    """All metrics, complexities, their ranks and whether thresholds are exceeded, of each file."""
    joined = node_metrics(nodes).join(nesting_depth(nodes), "file_id").join(recursion_metrics(nodes).drop("recursive_functions"), "file_id", "left")
    joined = joined.withColumn("recursion_count", F.coalesce("recursion_count", F.lit(0)))
    over = {f"{name}_exceeds": F.col(column) > THRESHOLDS[name] for name, column in (("loops", "loops_total"), ("nesting", "nesting_max_depth"), ("recursion", "recursion_count"), ("pointers", "pointers_total"), ("stl", "stl_total"), ("allocations", "alloc_total"))}
    joined = joined.withColumns(over)
    time, time_sure = time_complexity(F.col("loops_total"), F.col("nesting_max_depth"), F.col("recursion_count"), F.col("stl_algorithm_calls"), F.col("loops_exceeds"), F.col("nesting_exceeds"))
    space, space_sure = space_complexity(F.col("recursion_count"), F.col("alloc_total"), F.lit(THRESHOLDS["allocations"]))
    joined = joined.withColumns({"time_big_o": time, "time_confidence": time_sure, "space_big_o": space, "space_confidence": space_sure})
    return joined.withColumns({"complexity_time_rank": big_o_rank(F.col("time_big_o")), "complexity_time_rank_ext": big_o_rank_extended(F.col("time_big_o")), "complexity_space_rank": big_o_rank(F.col("space_big_o"))})


def dead_code(nodes: DataFrame) -> DataFrame:
    """Executable nodes of a block behind a node of the block that ends it."""
    blocks = nodes.filter(_is("COMPOUND_STMT")).select("file_id", F.col("node_id").alias("parent_id"))
    before = Window.partitionBy("file_id", "parent_id").orderBy("ordinal", "pre").rowsBetween(Window.unboundedPreceding, -1)
    own = nodes.join(blocks, ["file_id", "parent_id"]).withColumn("ended", F.max(_is(*TERMINATORS).cast("int")).over(before))
    return own.filter((F.col("ended") == 1) & ~_is(*NOT_EXECUTED)).select("file_id", "node_id", "kind", "line")


def unused_declarations(nodes: DataFrame) -> DataFrame:
    """Variables that no reference of their file names. There is no scoping: a name used anywhere is used."""
    declared = nodes.filter(_is("VAR_DECL") & F.col("identifier").isNotNull()).select("file_id", "node_id", "identifier", "line")
    used = nodes.filter(_is("DECL_REF_EXPR")).select("file_id", "identifier")
    return declared.join(used, ["file_id", "identifier"], "left_anti").select("file_id", "node_id", "identifier", "line")


def unsafe_calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_is("CALL_EXPR") & F.col("label").rlike(ascii_word("strcpy|strcat|gets|sprintf"))).select("file_id", "node_id", "identifier", "line")


def copy_hotspots(nodes: DataFrame) -> DataFrame:
    """Parameters of library types by value."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    return nodes.filter(_is("PARM_DECL") & kind.contains("std::") & ~kind.contains("&") & ~kind.contains("*")).select("file_id", "node_id", "identifier", "type", "line")


def allocation_imbalance(metrics: DataFrame) -> DataFrame:
    """file_id, new_delete, malloc_free of files that allocate more often than they free."""
    new, malloc = F.col("alloc_heap_new") - F.col("alloc_heap_delete"), F.col("alloc_malloc_family") - F.col("alloc_free_calls")
    return metrics.filter((new > 0) | (malloc > 0)).select("file_id", new.alias("new_delete"), malloc.alias("malloc_free"))


def _confidence(start: float, slope: Column) -> Column:
    return F.least(F.lit(0.99), start + slope)


def long_functions(nodes: DataFrame) -> DataFrame:
    """Functions with more than 20 statements below them, counted as a difference of running counts."""
    statement = (F.col("kind").endswith("_STMT") & ~_is("COMPOUND_STMT", "NULL_STMT")) | _is(*COUNTED)
    upto = F.sum(statement.cast("int")).over(Window.partitionBy("file_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    counted = nodes.withColumn("upto", upto).select("file_id", "node_id", "kind", "identifier", "line", "pre", "last", "upto")
    ends = counted.select("file_id", F.col("pre").alias("last"), F.col("upto").alias("end_upto"))
    functions = counted.filter(_is(*FUNCTIONS)).join(ends, ["file_id", "last"])
    most = THRESHOLDS["long_function"]
    found = functions.withColumn("statements", F.col("end_upto") - F.col("upto")).filter(F.col("statements") > most)
    return found.select("file_id", "node_id", "identifier", "line", "statements", _confidence(0.6, (F.col("statements") - most) / (most * 2)).alias("confidence"))


def large_classes(nodes: DataFrame) -> DataFrame:
    members = nodes.filter(_is(*MEMBERS)).groupBy("file_id", "parent_id").agg(F.count("*").alias("members"))
    most = THRESHOLDS["large_class"]
    types = nodes.filter(_is("CLASS_DECL", "STRUCT_DECL")).select("file_id", F.col("node_id").alias("parent_id"), "identifier", "line")
    found = types.join(members.filter(F.col("members") > most), ["file_id", "parent_id"])
    return found.select("file_id", F.col("parent_id").alias("node_id"), "identifier", "line", "members", _confidence(0.62, (F.col("members") - most) * 0.04).alias("confidence"))


def magic_numbers(nodes: DataFrame) -> DataFrame:
    """Files with more than four literals other than 0, 1 and -1, and where the first stands."""
    texts = F.concat_ws(" ", "spelling", "displayname", "name", "raw")
    value = F.nullif(F.regexp_extract(texts, r"-?\d+(\.\d+)?", 0), F.lit("")).cast("double")
    found = nodes.filter(_is("INTEGER_LITERAL", "FLOATING_LITERAL")).withColumn("value", value).filter("value is not null and value not in (0, 1, -1)")
    most = THRESHOLDS["magic_numbers"]
    grouped = found.groupBy("file_id").agg(F.count("*").alias("numbers"), F.min_by("line", "pre").alias("line")).filter(F.col("numbers") > most)
    return grouped.select("file_id", "line", "numbers", _confidence(0.58, (F.col("numbers") - most) * 0.06).alias("confidence"))


def duplicate_blocks(nodes: DataFrame, block: str = "COMPOUND_STMT", all_signatures: bool = False) -> DataFrame:
    """Blocks of at least three children that have the same kinds in the same order as another; each file's first such, or all."""
    children = nodes.groupBy("file_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "pre", "kind"))), lambda x: x["kind"]), ">").alias("signature"), F.count("*").alias("n"))
    blocks = nodes.filter(_is(block)).select("file_id", F.col("node_id").alias("parent_id"), "pre", "line")
    signed = blocks.join(children.filter("n >= 3"), ["file_id", "parent_id"])
    same = signed.groupBy("file_id", "signature").agg(F.count("*").alias("blocks"), F.min("pre").alias("first_pre"), F.min_by("line", "pre").alias("line")).filter(F.col("blocks") > THRESHOLDS["duplicate_blocks"])
    found = same.withColumn("confidence", _confidence(0.64, (F.col("blocks") - 1) * 0.08))
    if all_signatures:
        return found
    first = found.groupBy("file_id").agg(F.min_by(F.struct("signature", "blocks", "first_pre", "line", "confidence"), "first_pre").alias("x"))
    return first.select("file_id", "x.*")


def semantic_issues(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """All findings of the checks, long form: file_id, issue_id, check_type, severity, node_id, line, in the checks' order by check_no."""

    def rows(found: DataFrame, no: int, issue: str, check: str, severity: str) -> DataFrame:
        node, line = (F.col(c) if c in found.columns else F.lit(None) for c in ("node_id", "line"))
        return found.select("file_id", F.lit(no).alias("check_no"), F.lit(issue).alias("issue_id"), F.lit(check).alias("check_type"), F.lit(severity).alias("severity"), node.cast("string").alias("node_id"), line.cast("int").alias("line"))

    balance = allocation_imbalance(metrics)
    parts = [
        rows(dead_code(nodes), 1, "semantic.dead-code.after-terminator", "dead_code", "MEDIUM"),
        rows(unused_declarations(nodes), 2, "semantic.unused-variable", "unused_variable", "LOW"),
        rows(balance.filter("new_delete > 0"), 3, "semantic.memory.new-delete-imbalance", "memory_risk", "HIGH"),
        rows(balance.filter("malloc_free > 0"), 4, "semantic.memory.malloc-free-imbalance", "memory_risk", "HIGH"),
        rows(unsafe_calls(nodes), 5, "semantic.memory.unsafe-c-api", "memory_risk", "HIGH"),
        rows(copy_hotspots(nodes), 6, "semantic.copy-hotspot.pass-by-value", "copy_hotspot", "MEDIUM"),
    ]
    return reduce(DataFrame.unionByName, parts)


def code_smells(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """All smells, long form: file_id, smell_type, severity, line, confidence, in their order by smell_no."""
    deepest = THRESHOLDS["deep_nesting"]
    deep = features.filter(F.col("nesting_max_depth") > deepest).withColumn("confidence", _confidence(0.65, (F.col("nesting_max_depth") - deepest) * 0.07)).withColumn("line", F.lit(None))
    parts = [(long_functions(nodes), 1, "long_function", "MEDIUM"), (deep, 2, "deep_nesting", "HIGH"), (large_classes(nodes), 3, "large_class", "MEDIUM"), (magic_numbers(nodes), 4, "magic_numbers", "LOW"), (duplicate_blocks(nodes), 5, "duplicate_blocks", "MEDIUM")]
    rows = [x.select("file_id", F.lit(no).alias("smell_no"), F.lit(name).alias("smell_type"), F.lit(severity).alias("severity"), F.col("line").cast("int").alias("line"), "confidence") for x, no, name, severity in parts]
    return reduce(DataFrame.unionByName, rows)
