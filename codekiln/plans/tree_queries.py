"""Syntax-tree operators, over the key hierarchy of customers, orders and line items read as trees.

A customer is a file, its orders are functions, types and blocks, and their line
items the statements. The view is one SQL text for Spark and for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.operators import ast_nodes as a
from codekiln.plans.catalog import table
from codekiln.session import materialize
from codekiln.sources.trees import flatten_trees

TREE = """
    select file_id, node_id, parent_id, cast(ordinal as int) as ordinal, depth, pre, case when depth = 0 then count(*) over (partition by file_id) - 1 when depth = 1 then pre + n - 1 else pre end as last,
        kind, spelling, type, cast(pre % 400 + 1 as int) as line
    from (
        select *, row_number() over (partition by file_id order by o, l nulls first) - 1 as pre, count(*) over (partition by file_id, o) as n,
            row_number() over (partition by parent_id order by o, l nulls first) as ordinal
        from (
            select c_custkey as file_id, concat('c', c_custkey) as node_id, cast(null as string) as parent_id, 0 as depth, cast(-1 as bigint) as o, cast(null as bigint) as l,
                'CursorKind.TRANSLATION_UNIT' as kind, 'unit' as spelling, cast(null as string) as type from {customer}
            union all
            select o_custkey, concat('o', o_orderkey), concat('c', o_custkey), 1, o_orderkey, cast(null as bigint),
                case o_orderkey % 7 when 0 then 'CursorKind.FUNCTION_DECL' when 1 then 'CursorKind.CXX_METHOD' when 2 then 'CursorKind.CLASS_DECL' when 3 then 'CursorKind.COMPOUND_STMT' when 4 then 'CursorKind.FOR_STMT' when 5 then 'CursorKind.COMPOUND_STMT' else 'CursorKind.IF_STMT' end,
                concat('f', o_orderkey % 5), 'int ()' from {orders}
            union all
            select o_custkey, concat('l', l_orderkey, '_', i), concat('o', l_orderkey), 2, l_orderkey, i,
                case l_partkey % 19 when 0 then 'CALL_EXPR' when 1 then 'VAR_DECL' when 2 then 'DECL_REF_EXPR' when 3 then 'RETURN_STMT' when 4 then 'FOR_STMT' when 5 then 'WHILE_STMT' when 6 then 'IF_STMT' when 7 then 'CXX_NEW_EXPR'
                    when 8 then 'CXX_DELETE_EXPR' when 9 then 'INTEGER_LITERAL' when 10 then 'PARM_DECL' when 11 then 'UNARY_OPERATOR' when 12 then 'BINARY_OPERATOR' when 13 then 'FIELD_DECL' when 14 then 'CALL_EXPR' when 15 then 'CXX_FOR_RANGE_STMT' when 16 then 'INTEGER_LITERAL' when 17 then 'VAR_DECL' else 'DO_STMT' end,
                case when l_partkey % 19 in (9, 16) then cast(l_suppkey % 9 as string) when l_partkey % 19 = 0 then case l_suppkey % 5 when 0 then 'malloc' when 1 then 'free' when 2 then 'strcpy' when 3 then 'std::sort' else 'realloc' end else concat('f', l_suppkey % 5) end,
                case l_suppkey % 7 when 0 then 'int' when 1 then 'int *' when 2 then 'std::vector<int>' when 3 then 'std::string &' when 4 then 'char [32]' when 5 then 'std::map<int, int>::iterator' else 'p->next' end
            from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as i from {lineitem}) as items join {orders} on l_orderkey = o_orderkey
        ) as nodes
    ) as placed
"""


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return a.prepared(spark.sql(TREE, **{t: table(spark, folder, t) for t in ("customer", "orders", "lineitem")}))


def kept_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The tree as a written table, for queries that go over it more than once."""
    return materialize(tree(spark, folder), "tree")


def ast_node_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return a.node_metrics(tree(spark, folder))


def ast_nesting_depth(spark: SparkSession, folder: str) -> DataFrame:
    return a.nesting_depth(tree(spark, folder))


def ast_recursion(spark: SparkSession, folder: str) -> DataFrame:
    return a.recursion_metrics(kept_tree(spark, folder)).select("file_id", "recursion_count", F.array_join("recursive_functions", ",").alias("recursive_functions"))


def ast_features(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["file_id", "loops_total", "nesting_max_depth", "recursion_count", "loops_exceeds", "nesting_exceeds", "allocations_exceeds", "time_big_o", "time_confidence", "space_big_o", "space_confidence", "complexity_time_rank", "complexity_space_rank"]
    return a.file_features(kept_tree(spark, folder)).select(columns)


def ast_dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return a.dead_code(tree(spark, folder))


def ast_unused_decl(spark: SparkSession, folder: str) -> DataFrame:
    return a.unused_declarations(tree(spark, folder))


def ast_unsafe_calls(spark: SparkSession, folder: str) -> DataFrame:
    return a.unsafe_calls(tree(spark, folder))


def copy_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return a.copy_hotspots(tree(spark, folder))


def ast_alloc_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    return a.allocation_imbalance(a.node_metrics(tree(spark, folder)))


def ast_long_function(spark: SparkSession, folder: str) -> DataFrame:
    """The orders of a customer taken together: the unit itself counts as a function here."""
    nodes = tree(spark, folder).withColumn("kind", F.when(F.col("kind") == "TRANSLATION_UNIT", "FUNCTION_DECL").otherwise(F.col("kind")))
    return a.long_functions(nodes).withColumn("confidence", F.round("confidence", 9))


def ast_large_class(spark: SparkSession, folder: str) -> DataFrame:
    """Members of whole units: their order-level methods and the like."""
    nodes = tree(spark, folder)
    flat = nodes.withColumn("parent_id", F.when(F.col("depth") == 2, F.concat(F.lit("c"), "file_id")).otherwise(F.col("parent_id"))).withColumn("kind", F.when(F.col("depth") == 0, "CLASS_DECL").otherwise(F.col("kind")))
    return a.large_classes(flat).withColumn("confidence", F.round("confidence", 9))


def ast_magic_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return a.magic_numbers(tree(spark, folder)).withColumn("confidence", F.round("confidence", 9))


def ast_duplicate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds are made coarse, so that some blocks are alike."""
    nodes = tree(spark, folder).withColumn("kind", F.when(F.col("depth") == 2, F.when(F.col("ordinal") % 2 == 0, "A").otherwise("B")).otherwise(F.col("kind")))
    return a.duplicate_blocks(nodes, all_signatures=True).select("file_id", "signature", "blocks", "line", F.round("confidence", 9).alias("confidence"))


def semantic_issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    nodes = kept_tree(spark, folder)
    return a.semantic_issues(nodes, a.node_metrics(nodes)).groupBy("check_type", "severity", "issue_id").agg(F.count("*").alias("issues"), F.countDistinct("file_id").alias("files"))


def code_smell_counts(spark: SparkSession, folder: str) -> DataFrame:
    nodes = kept_tree(spark, folder)
    return a.code_smells(nodes, a.file_features(nodes)).groupBy("smell_type", "severity").agg(F.count("*").alias("smells"), F.round(F.max("confidence"), 9).alias("most_sure"))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(spark.sql(TREE, **{t: table(spark, folder, t) for t in ("customer", "orders", "lineitem")}), "raw-tree")


def json_trees(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, document: the trees as their producer writes them, nodes with their children as JSON."""
    nodes = _raw(spark, folder)
    place = F.struct(F.concat("file_id", F.lit(".cpp")).alias("file"), "line", F.lit(1).alias("column"))
    node = ["kind", "spelling", "type", place.alias("location")]
    below = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*rows).alias("node")))), lambda x: x["node"])
    leaves = nodes.filter("depth = 2").groupBy(F.col("parent_id").alias("node_id")).agg(below(node).alias("children"))
    middle = nodes.filter("depth = 1").join(leaves, "node_id", "left").groupBy(F.col("parent_id").alias("node_id")).agg(below([*node, "children"]).alias("children"))
    roots = nodes.filter("depth = 0").join(middle, "node_id", "left")
    return roots.select("file_id", F.to_json(F.struct(F.struct(*node, "children").alias("translationUnit"))).alias("document"))


def dump_trees(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, document: the trees as a compiler's text dump, a line for each node, two columns for each level."""
    kind = F.replace(F.initcap(F.replace(F.lower(F.regexp_replace("kind", r"^CursorKind\.", "")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    bars = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit("| "), F.col("depth") - 1), F.lit("|-"))).otherwise("")
    line = F.concat(bars, kind, F.format_string(" 0x%x <line:%d:1> ", F.col("pre") + 4096, F.col("line")), F.coalesce("spelling", F.lit("")))
    lines = _raw(spark, folder).select("file_id", "pre", line.alias("text"))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "\n").alias("document"))


def ast_json_features(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and depths of trees that are read from JSON documents."""
    nodes = a.prepared(flatten_trees(json_trees(spark, folder), "file_id", "document"))
    nodes = materialize(nodes, "json-tree")
    places = nodes.groupBy("file_id").agg(F.count("*").alias("nodes"), F.sum("line").alias("lines"), F.sum("depth").alias("depths"), F.sum(F.col("last") - F.col("pre")).alias("below"))
    found = a.node_metrics(nodes).join(a.nesting_depth(nodes), "file_id").join(places, "file_id")
    return found.withColumn("file_id", F.col("file_id").cast("long"))


def ast_dump_features(spark: SparkSession, folder: str) -> DataFrame:
    """Loops, depths and places of trees that are read from text dumps."""
    nodes = materialize(a.prepared(flatten_trees(dump_trees(spark, folder), "file_id", "document", dump=True)), "dump-tree")
    places = nodes.groupBy("file_id").agg(F.count("*").alias("nodes"), F.sum("line").alias("lines"), F.sum("depth").alias("depths"), F.sum(F.col("last") - F.col("pre")).alias("below"))
    found = a.node_metrics(nodes).select("file_id", "loops_for", "loops_while", "loops_do_while", "loops_range_for", "loops_total").join(a.nesting_depth(nodes), "file_id").join(places, "file_id")
    return found.withColumn("file_id", F.col("file_id").cast("long"))


QUERIES = [ast_json_features, ast_dump_features, ast_node_metrics, ast_nesting_depth, ast_recursion, ast_features, ast_dead_code, ast_unused_decl, ast_unsafe_calls, copy_hotspots, ast_alloc_imbalance, ast_long_function, ast_large_class, ast_magic_numbers, ast_duplicate_blocks, semantic_issue_counts, code_smell_counts]

_TREE = TREE.format(customer="customer", orders="orders", lineitem="lineitem")


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_NODES = f"""t as (select *, regexp_replace(kind0, '^CursorKind\\.', '') as kind, lower(concat_ws(' ', spelling, type)) as label, spelling as identifier from (select * exclude (kind), kind as kind0 from ({_TREE})))"""
_METRICS = f"""m as (select file_id, cast(count(*) filter (kind = 'FOR_STMT') as bigint) as loops_for, count(*) filter (kind = 'WHILE_STMT') as loops_while, count(*) filter (kind = 'DO_STMT') as loops_do_while, count(*) filter (kind = 'CXX_FOR_RANGE_STMT') as loops_range_for,
    count(distinct case when kind in {_in(a.FUNCTIONS)} then identifier end) as function_count,
    count(*) filter (kind in ('VAR_DECL', 'PARM_DECL', 'FIELD_DECL') and contains(label, '*')) as pointers_declarations,
    count(*) filter (kind in ('UNARY_OPERATOR', 'CXX_OPERATOR_CALL_EXPR') and (contains(label, 'operator*') or regexp_matches(label, '\\s\\*'))) + count(*) filter (contains(label, '->')) as pointers_dereferences,
    count(*) filter (kind in ('UNARY_OPERATOR', 'CXX_OPERATOR_CALL_EXPR') and (contains(label, 'operator&') or regexp_matches(label, '\\s&'))) as pointers_address_of,
    {' + '.join(f"count(*) filter (contains(label, '{x}'))" for x in a.CONTAINERS)} as stl_container_refs, {' + '.join(f"count(*) filter (contains(label, '{x}'))" for x in a.ALGORITHMS)} as stl_algorithm_calls,
    count(*) filter (contains(label, 'iterator')) as stl_iterator_usage, count(*) filter (kind = 'CXX_NEW_EXPR') as alloc_heap_new, count(*) filter (kind = 'CXX_DELETE_EXPR') as alloc_heap_delete,
    count(*) filter (kind = 'CALL_EXPR' and regexp_matches(label, '\\b(malloc|calloc|realloc)\\b')) as alloc_malloc_family, count(*) filter (kind = 'CALL_EXPR' and regexp_matches(label, '\\bfree\\b')) as alloc_free_calls,
    count(*) filter (kind = 'VAR_DECL' and contains(lower(type), '[')) as alloc_stack_arrays from t group by file_id),
    mt as (select *, loops_for + loops_while + loops_do_while + loops_range_for as loops_total, pointers_declarations + pointers_dereferences + pointers_address_of as pointers_total, stl_container_refs + stl_algorithm_calls + stl_iterator_usage as stl_total,
        alloc_heap_new + alloc_heap_delete + alloc_malloc_family + alloc_free_calls + alloc_stack_arrays as alloc_total from m)"""
_DEPTH = f"""d as (select u.file_id, cast(coalesce(max(n), 0) as int) as nesting_max_depth from (select distinct file_id from t) u left join
    (select x.file_id, x.pre, count(*) as n from t x join t y on x.file_id = y.file_id and y.pre <= x.pre and x.pre <= y.last and y.kind in {_in(a.CONTROLS)} where x.kind in {_in(a.CONTROLS)} group by 1, 2) s on u.file_id = s.file_id group by u.file_id)"""
_RECURSION = f"""rc as (select c.file_id, c.node_id, c.identifier, (select arg_max(f.identifier, f.pre) from t f where f.file_id = c.file_id and f.kind in {_in(a.FUNCTIONS)} and f.pre < c.pre and c.pre <= f.last) as owner from t c where c.kind in {_in(a.CALLS)}),
    r as (select file_id, count(distinct identifier) as recursion_count, string_agg(distinct identifier, ',' order by identifier) as recursive_functions from rc where identifier = owner group by file_id)"""
_DEAD = f"""dc as (select file_id, node_id, kind, line from (select x.*, max(case when x.kind in {_in(a.TERMINATORS)} then 1 else 0 end) over (partition by x.parent_id order by x.pre rows between unbounded preceding and 1 preceding) as ended from t x join t b on x.parent_id = b.node_id and b.kind = 'COMPOUND_STMT') where ended = 1 and kind not in {_in(a.NOT_EXECUTED)})"""
_UNUSED = "un as (select file_id, node_id, identifier, line from t v where kind = 'VAR_DECL' and not exists (select 1 from t u where u.file_id = v.file_id and u.kind = 'DECL_REF_EXPR' and u.identifier = v.identifier))"
_UNSAFE = "us as (select file_id, node_id, identifier, line from t where kind = 'CALL_EXPR' and regexp_matches(label, '\\b(strcpy|strcat|gets|sprintf)\\b'))"
_COPIES = "cp as (select file_id, node_id, identifier, type, line from t where kind = 'PARM_DECL' and contains(lower(type), 'std::') and not contains(type, '&') and not contains(type, '*'))"
_STATEMENT = f"((ends_with(x.kind, '_STMT') and x.kind not in ('COMPOUND_STMT', 'NULL_STMT')) or x.kind in {_in(a.COUNTED)})"

_PLACES = "pl as (select file_id, count(*) as nodes, cast(sum(line) as bigint) as lines, cast(sum(depth) as bigint) as depths, cast(sum(last - pre) as bigint) as below from t group by file_id)"

SQL = {
    "ast_json_features": f"with {_NODES}, {_METRICS}, {_DEPTH}, {_PLACES} select * from mt join d using (file_id) join pl using (file_id)",
    "ast_dump_features": f"with {_NODES}, {_METRICS}, {_DEPTH}, {_PLACES} select file_id, loops_for, loops_while, loops_do_while, loops_range_for, loops_total, nesting_max_depth, nodes, lines, depths, below from mt join d using (file_id) join pl using (file_id)",
    "code_smell_counts": f"""with {_NODES}, {_DEPTH}, lf as (select f.file_id, (select count(*) from t x where x.file_id = f.file_id and x.pre > f.pre and x.pre <= f.last and {_STATEMENT}) as n from t f where f.kind in {_in(a.FUNCTIONS)}),
        lc as (select c.file_id, count(*) as n from t c join t x on x.file_id = c.file_id and x.parent_id = c.node_id and x.kind in {_in(a.MEMBERS)} where c.kind in ('CLASS_DECL', 'STRUCT_DECL') group by c.file_id, c.node_id),
        mn as (select file_id, count(*) as n from t where kind = 'INTEGER_LITERAL' and try_cast(spelling as double) not in (0, 1, -1) group by file_id),
        bs as (select b.file_id, b.pre, string_agg(x.kind, '>' order by x.ordinal, x.pre) as signature from t b join t x on x.file_id = b.file_id and x.parent_id = b.node_id where b.kind = 'COMPOUND_STMT' group by 1, 2 having count(*) >= 3),
        db as (select file_id, arg_min(n, first) as n from (select file_id, signature, count(*) as n, min(pre) as first from bs group by 1, 2 having count(*) > 1) group by file_id),
        s as (select 'long_function' as smell_type, 'MEDIUM' as severity, 0.6::double + (n - 20)::double / 40 as c from lf where n > 20 union all select 'deep_nesting', 'HIGH', 0.65::double + (nesting_max_depth - 4) * 0.07::double from d where nesting_max_depth > 4
            union all select 'large_class', 'MEDIUM', 0.62::double + (n - 12) * 0.04::double from lc where n > 12 union all select 'magic_numbers', 'LOW', 0.58::double + (n - 4) * 0.06::double from mn where n > 4
            union all select 'duplicate_blocks', 'MEDIUM', 0.64::double + (n - 1) * 0.08::double from db)
        select smell_type, severity, count(*) as smells, round(max(least(0.99::double, c)), 9) as most_sure from s group by 1, 2""",
    "ast_node_metrics": f"with {_NODES}, {_METRICS} select * from mt",
    "ast_nesting_depth": f"with {_NODES}, {_DEPTH} select * from d",
    "ast_recursion": f"with {_NODES}, {_RECURSION} select * from r",
    "ast_features": f"""with {_NODES}, {_METRICS}, {_DEPTH}, {_RECURSION}, j as (select mt.*, d.nesting_max_depth, coalesce(r.recursion_count, 0) as recursion_count from mt join d using (file_id) left join r using (file_id)),
        e as (select *, loops_total > 8 as loops_exceeds, nesting_max_depth > 4 as nesting_exceeds, alloc_total > 6 as allocations_exceeds,
            case when recursion_count > 0 then case when nesting_max_depth >= 1 or loops_total > 0 then 'O(n^2)' else 'O(n)' end when loops_total > 0 then case when nesting_max_depth <= 1 then 'O(n)' when nesting_max_depth = 2 then 'O(n^2)' else 'O(n^' || nesting_max_depth || ')' end when stl_algorithm_calls > 0 then 'O(n log n)' else 'O(1)' end as time_big_o,
            case when recursion_count > 0 then 'low' when loops_total > 0 and nesting_max_depth <= 2 then 'high' else 'medium' end as sure, case when recursion_count > 0 or alloc_total > 0 then 'O(n)' else 'O(1)' end as space_big_o,
            case when alloc_total > 0 then case when alloc_total > 6 then 'medium' else 'low' end when recursion_count > 0 then 'low' else 'medium' end as space_confidence from j)
        select file_id, loops_total, nesting_max_depth, recursion_count, loops_exceeds, nesting_exceeds, allocations_exceeds, time_big_o, case when loops_exceeds or nesting_exceeds then case when sure = 'high' then 'medium' else 'low' end else sure end as time_confidence, space_big_o, space_confidence,
        case time_big_o when 'O(1)' then 1 when 'O(n)' then 3 when 'O(n log n)' then 4 when 'O(n^2)' then 5 when 'O(n^3)' then 6 else 0 end as complexity_time_rank, case space_big_o when 'O(1)' then 1 else 3 end as complexity_space_rank from e""",
    "ast_dead_code": f"with {_NODES}, {_DEAD} select * from dc",
    "ast_unused_decl": f"with {_NODES}, {_UNUSED} select * from un",
    "ast_unsafe_calls": f"with {_NODES}, {_UNSAFE} select * from us",
    "copy_hotspots": f"with {_NODES}, {_COPIES} select * from cp",
    "ast_alloc_imbalance": f"with {_NODES}, {_METRICS} select file_id, alloc_heap_new - alloc_heap_delete as new_delete, alloc_malloc_family - alloc_free_calls as malloc_free from m where alloc_heap_new > alloc_heap_delete or alloc_malloc_family > alloc_free_calls",
    "ast_long_function": f"""with {_NODES}, f as (select f.file_id, f.node_id, f.identifier, f.line, (select count(*) from t x where x.file_id = f.file_id and x.pre > f.pre and x.pre <= f.last and {_STATEMENT}) as statements from t f where f.kind in {_in([*a.FUNCTIONS, 'TRANSLATION_UNIT'])})
        select *, round(least(0.99::double, 0.6::double + (statements - 20)::double / 40), 9) as confidence from f where statements > 20""",
    "ast_large_class": f"""with {_NODES}, f as (select file_id, count(*) as members from t where depth > 0 and kind in {_in(a.MEMBERS)} group by file_id having count(*) > 12)
        select f.file_id, t.node_id, t.identifier, t.line, members, round(least(0.99::double, 0.62::double + (members - 12) * 0.04::double), 9) as confidence from f join t on f.file_id = t.file_id and t.depth = 0""",
    "ast_magic_numbers": f"""with {_NODES}, v as (select file_id, pre, line from t where kind = 'INTEGER_LITERAL' and cast(spelling as double) not in (0, 1, -1))
        select file_id, arg_min(line, pre) as line, count(*) as numbers, round(least(0.99::double, 0.58::double + (count(*) - 4) * 0.06::double), 9) as confidence from v group by file_id having count(*) > 4""",
    "ast_duplicate_blocks": f"""with {_NODES}, s as (select b.file_id, b.node_id, b.pre, b.line, string_agg(case when x.ordinal % 2 = 0 then 'A' else 'B' end, '>' order by x.ordinal) as signature, count(*) as n from t b join t x on x.parent_id = b.node_id where b.kind = 'COMPOUND_STMT' group by 1, 2, 3, 4 having count(*) >= 3)
        select file_id, signature, count(*) as blocks, arg_min(line, pre) as line, round(least(0.99::double, 0.64::double + (count(*) - 1) * 0.08::double), 9) as confidence from s group by file_id, signature having count(*) > 1""",
    "semantic_issue_counts": f"""with {_NODES}, {_METRICS}, {_DEAD}, {_UNUSED}, {_UNSAFE}, {_COPIES}, i as (
        select file_id, 'dead_code' as check_type, 'MEDIUM' as severity, 'semantic.dead-code.after-terminator' as issue_id from dc union all select file_id, 'unused_variable', 'LOW', 'semantic.unused-variable' from un
        union all select file_id, 'memory_risk', 'HIGH', 'semantic.memory.new-delete-imbalance' from m where alloc_heap_new > alloc_heap_delete union all select file_id, 'memory_risk', 'HIGH', 'semantic.memory.malloc-free-imbalance' from m where alloc_malloc_family > alloc_free_calls
        union all select file_id, 'memory_risk', 'HIGH', 'semantic.memory.unsafe-c-api' from us union all select file_id, 'copy_hotspot', 'MEDIUM', 'semantic.copy-hotspot.pass-by-value' from cp)
        select check_type, severity, issue_id, count(*) as issues, count(distinct file_id) as files from i group by all""",
}
