"""All queries of the engine's own operators over whole tables, and the same in SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.operators.nested import CHILD_KINDS, SECTION_KINDS, children, emit_records, flat_table, read_table, write_tables
from codekiln.plans import diagnostic_queries, profiling_queries, rule_queries, source_queries, tree_queries
from codekiln.plans.catalog import table
from codekiln.session import scratch_dir

MODULES = [profiling_queries, diagnostic_queries, tree_queries, rule_queries, source_queries]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return children(emit_records(table(spark, folder, "analyses")))


def p2_code_smells(spark: SparkSession, folder: str) -> DataFrame:
    return flat_table(emit_records(table(spark, folder, "analyses")), "code_smell")


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The emission written by tag, and of each child table, read with its schema, the rows and the analyses they belong to."""
    path = os.path.join(scratch_dir(spark), f"nested-{uuid.uuid4().hex}")
    write_tables(emit_records(table(spark, folder, "analyses")), path)
    read = [read_table(spark, path, tag).select(F.lit(tag).alias("table_tag"), "analysis_id", "parent_key") for tag in CHILD_KINDS]
    return reduce(DataFrame.unionByName, read).groupBy("table_tag").agg(F.count("*").alias("n_rows"), F.countDistinct("parent_key").alias("n_parents"))


def p2_section_tables(spark: SparkSession, folder: str) -> DataFrame:
    """As p2_tables for the records that an analysis has one of: itself and its sections, with how many name a scope."""
    path = os.path.join(scratch_dir(spark), f"nested-{uuid.uuid4().hex}")
    write_tables(emit_records(table(spark, folder, "analyses")), path)
    tables = {tag: read_table(spark, path, tag) for tag in SECTION_KINDS}
    read = [own.select(F.lit(tag).alias("table_tag"), "record_key", (F.col("scope") if "scope" in own.columns else F.lit(None).cast("string")).alias("scope")) for tag, own in tables.items()]
    return reduce(DataFrame.unionByName, read).groupBy("table_tag").agg(F.count("*").alias("n_rows"), F.count("scope").alias("n_scopes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [p2_found, p2_code_smells, p2_tables, p2_section_tables, *(q for m in MODULES for q in m.QUERIES)]}


def _object(x: str) -> str:
    """x if it is a JSON object or the text of one."""
    text = f"json_extract_string({x}, '$')"
    return f"(case json_type({x}) when 'OBJECT' then {x} when 'VARCHAR' then case when json_valid({text}) and json_type({text}) = 'OBJECT' then cast({text} as json) end end)"


def _elements(x: str) -> str:
    return f"(case when {x} is null or json_type({x}) = 'NULL' then [] when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') else [{x}] end)"


def _rows(kind: str, parent: str, source: str, column: str) -> str:
    return f"select analysis_id, '{kind}' as child_kind, {parent} as parent_no, generate_subscripts({column}, 1) - 1 as child_no, unnest({column}) as item from {source}"


P2_PARTS = f"""
    with ranked as (select analysis_id, payload, row_number() over (partition by analysis_id order by received_at desc nulls last, payload desc nulls last) as k from analyses where analysis_id is not null),
    plain as (select analysis_id, case when json_valid(payload) then cast(payload as json) end as p from ranked where k = 1),
    docs as (select analysis_id, {_object("p")} as d from plain),
    parts as (select analysis_id, {_object("json_extract(d, '$.semanticChecks')")} as sc, {_object("json_extract(d, '$.codeSmells')")} as cs, {_object("json_extract(d, '$.features')")} as fe,
        {_object("case when coalesce(json_type(json_extract(d, '$.complexityEstimate')), 'NULL') = 'NULL' then json_extract(d, '$.complexity') else json_extract(d, '$.complexityEstimate') end")} as ce from docs where d is not null)"""
P2_SQL = f"""{P2_PARTS},
    lists as (select analysis_id, {_elements("json_extract(sc, '$.issues')")} as si, {_elements("json_extract(cs, '$.issues')")} as ci, {_elements("json_extract(" + _object("json_extract(fe, \'$.recursion\')") + ", \'$.recursiveFunctions\')")} as rf,
        {_elements("json_extract(" + _object("json_extract(ce, \'$.time\')") + ", \'$.notes\')")} as tn, {_elements("json_extract(" + _object("json_extract(ce, \'$.space\')") + ", \'$.notes\')")} as sn from parts),
    first as ({" union all ".join(_rows(kind, "-1", "lists", column) for kind, column in (("semantic_issue", "si"), ("code_smell", "ci"), ("recursive_function", "rf"), ("time_note", "tn"), ("space_note", "sn")))}),
    kept as (select * from first where json_type(item) <> 'NULL'),
    own as (select analysis_id, child_kind, child_no as no, {_elements("json_extract(" + _object("item") + ", '$.suggestions')")} as su from kept where child_kind in ('semantic_issue', 'code_smell')),
    second as (select analysis_id, case child_kind when 'semantic_issue' then 'semantic_suggestion' else 'smell_suggestion' end as child_kind, no as parent_no, generate_subscripts(su, 1) - 1 as child_no, unnest(su) as item from own)
    select analysis_id, child_kind, cast(parent_no as int) as parent_no, cast(child_no as int) as child_no from kept
    union all select analysis_id, child_kind, cast(parent_no as int), cast(child_no as int) from second where json_type(item) <> 'NULL'"""


def oracle_sql() -> dict[str, str]:
    tables = f"select child_kind as table_tag, count(*) as n_rows, count(distinct (analysis_id, child_kind, parent_no, case when parent_no < 0 then 0 else 1 end)) as n_parents from ({P2_SQL}) group by 1"
    scope = "json_extract_string({}, '$.scope')"
    time, space = (_object(f"json_extract(ce, '$.{x}')") for x in ("time", "space"))
    of = [("semantic_checks", "sc", scope.format("sc")), ("code_smells", "cs", scope.format("cs")), ("features", "fe", scope.format("fe")), ("complexity_estimate", "ce", scope.format("ce")), ("time_complexity", time, "null"), ("space_complexity", space, "null")]
    rows = " union all ".join(f"select '{tag}' as table_tag, {own} as own, {said} as said from parts" for tag, own, said in of)
    sections = f"{P2_PARTS} select table_tag, count(*) as n_rows, count(said) as n_scopes from (select 'analysis' as table_tag, d as own, null as said from docs union all {rows}) where own is not null group by 1"
    return {"p2_found": P2_SQL, "p2_tables": tables, "p2_section_tables": sections} | {name: sql for m in MODULES for name, sql in m.SQL.items()}
