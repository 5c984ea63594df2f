"""Files and folders, source lines and symbols, traces, rewrites, and text transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.functions import text as t
from codekiln.operators import refactor, requests, simulate, symbols, workspace
from codekiln.plans.catalog import table
from codekiln.sources import files as fs
from codekiln.sources.history import json_events


ALWAYS = ["Read the message.", "Compile again."]


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").select(F.concat_ws("/", "repo", "file_path").alias("path"))


def project_detect(spark: SparkSession, folder: str) -> DataFrame:
    return fs.detect_projects(_paths(spark, folder))


def workspace_tree(spark: SparkSession, folder: str) -> DataFrame:
    return fs.tree_of(_paths(spark, folder))


def path_rename(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "files").select("file_id", t.unified_path(F.col("file_path")).alias("path"))
    return workspace.removed(workspace.renamed(paths, "path", "src", "source\\main"), "path", "lib")


def tab_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Files with the code of later pairs of the same path: the last one counts."""
    files = table(spark, folder, "files").select("file_path", F.length("code").alias("n")).filter("file_path is not null").groupBy("file_path").agg(F.max("n").alias("n"))
    changes = table(spark, folder, "code_pairs").filter("file_path is not null").groupBy("file_path").agg(F.max_by(F.length("optimized"), F.struct("added_at", "pair_id")).alias("n"))
    return workspace.upserted(files, changes, ["file_path"])


def diag_files(spark: SparkSession, folder: str) -> DataFrame:
    """Which files messages may belong to, by path or name."""
    messages = table(spark, folder, "diagnostics").select("file_path").filter("file_path is not null").distinct()
    files = table(spark, folder, "files").select(F.col("file_path").alias("open_path")).filter("open_path is not null").distinct()
    return workspace.messages_of_files(messages, files, "file_path", "open_path")


def line_depths(spark: SparkSession, folder: str) -> DataFrame:
    lines = symbols.source_lines(table(spark, folder, "files").filter("code is not null"), "file_id", "code")
    return lines.groupBy("file_id").agg(F.count("*").alias("lines"), F.max("scope_depth").alias("deepest"), F.sum("scope_depth").alias("depths"))


def symbol_table(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.symbols(table(spark, folder, "files"), "file_id", "code")


def symbol_visibility(spark: SparkSession, folder: str) -> DataFrame:
    """What can be seen at each line."""
    lines = symbols.source_lines(table(spark, folder, "files").filter("code is not null"), "file_id", "code")
    return symbols.visible_symbols(symbol_table(spark, folder), lines, "file_id")


def included_headers(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.included_headers(table(spark, folder, "files"), "file_id", "code", symbols.STANDARD_HEADERS)


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """Names that the files declare or include, for the prefix m."""
    own = symbol_table(spark, folder).filter(F.length("name") > 1).select(F.col("name").alias("label"), F.lit("user").alias("source"))
    library = included_headers(spark, folder).select(F.col("header").alias("label"), F.lit("library").alias("source"))
    return symbols.ranked_completions(own.unionByName(library).distinct(), F.lit("m"))


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.trace_summaries(table(spark, folder, "files"), "file_id", "code")


def _heap_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "purchase", "allocate").when(F.col("event_type") == "click", "free")
    amount = F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("long"))
    return events.select("user_id", "event_id", "ts", kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("name"), amount.alias("amount")).filter("kind is not null")


def heap_running(spark: SparkSession, folder: str) -> DataFrame:
    events = simulate.heap_running(_heap_events(spark, folder), ["user_id"], ["ts", "event_id"], "kind", "amount")
    return events.select("event_id", "allocations", "frees", "live", "bytes_allocated", "bytes_freed", "bytes_live", "unknown_allocations", "unknown_frees")


def heap_freed(spark: SparkSession, folder: str) -> DataFrame:
    return simulate.freed_bytes(_heap_events(spark, folder), ["user_id"], ["ts", "event_id"], "kind", "name", "amount").filter("kind = 'free'").select("event_id", "freed")


def refactor_diff(spark: SparkSession, folder: str) -> DataFrame:
    return refactor.previews(table(spark, folder, "files"), "file_id", "code")


def format_code(spark: SparkSession, folder: str) -> DataFrame:
    cpp = table(spark, folder, "files").filter(F.lower("file_path").rlike(r"\.(cc|cpp|cxx|c\+\+)$"))
    return refactor.format_files(cpp, "file_id", "code").select("file_id", "formatted")


def history_json_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    return json_events(rows, "props", "k int").select("event_id", "k")


def text_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Cut, unfenced, balanced and escaped texts of documents, by their lengths."""
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.length(t.truncated(text, 300)).alias("cut"), F.length(t.largest_fence(text)).alias("fenced"), t.balance(text, "(", ")").alias("brackets"), F.length(t.angle_escaped(text)).alias("escaped"))


def request_check(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for timed runs that events stand for, and what is wrong with them."""
    more = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(', "compiler": "'), "event_type", F.lit('"'))).otherwise(""), F.when(F.col("event_id") % 7 == 0, ', "extra": 1').otherwise("")
    payload = F.concat(F.lit('{"runs": '), F.col("event_id") % 60, F.lit(', "warmupRuns": '), F.col("user_id") % 13, *more, F.when(F.col("event_id") % 11 != 0, "}").otherwise(""))
    rows = table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return requests.checked_requests(rows, "payload", "benchmark").select("event_id", F.array_join("problems", "; ").alias("problems"))


def argument_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of each entry behind two that all have, each once."""
    fixes = table(spark, folder, "error_db").select("id", requests.merged_arguments(ALWAYS, F.col("quick_fixes")).alias("xs"))
    return fixes.select("id", F.posexplode("xs").alias("place", "argument"))


def pair_generate(spark: SparkSession, folder: str) -> DataFrame:
    return fs.generate_pairs(spark)


QUERIES = [project_detect, workspace_tree, path_rename, tab_upsert, diag_files, line_depths, symbol_table, symbol_visibility, included_headers, completions, trace_summary, heap_running, heap_freed, refactor_diff, format_code, history_json_tolerant, text_transforms, request_check, argument_merge, pair_generate]

_PATHS = "p as (select distinct replace(concat_ws('/', repo, file_path), '\\', '/') as path from files)"
_UNIFIED = "regexp_replace(replace({0}, '/', '\\'), '(?i)^(?:.*\\\\)?workspace\\\\', '')"
_HEAP = """h as (select user_id, event_id, ts, case event_type when 'purchase' then 'allocate' else 'free' end as kind, 'v' || event_id % 3 as name, case when event_id % 7 <> 0 then cast(floor(value) as bigint) end as amount from events where event_type in ('purchase', 'click'))"""
_SO_FAR = "over (partition by user_id order by ts, event_id rows unbounded preceding)"

SQL = {
    "project_detect": f"""with {_PATHS}, q as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '([^/]*)$', 1) as name, regexp_matches(lower(path), '\\.(c|cc|cpp|cxx|c\\+\\+)$') as src from p),
        g as (select folder, bool_or(name = 'CMakeLists.txt') as cmake, count(*) filter (src) as source_files, arg_min(path, (case when regexp_matches(lower(name), '^main\\.') then 0 else 1 end, path)) filter (src) as entry_file from q group by folder)
        select folder, case when cmake then 'cmake' when source_files > 1 then 'multi-file' else 'single-file' end as type, source_files, entry_file from g where cmake or source_files > 0""",
    "workspace_tree": f"""with {_PATHS}, q as (select list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p), k as (select parts from q where not list_has_any(parts, ['.git', 'node_modules', 'build', 'dist', '.vscode']) and len(parts) > 0),
        d as (select parts, unnest(range(1, len(parts) + 1)) as depth from k) select distinct array_to_string(parts[1:depth], '/') as path, array_to_string(parts[1:depth - 1], '/') as parent, parts[depth] as name, depth < len(parts) as is_folder, cast(depth as int) as depth from d""",
    "path_rename": f"""with u as (select file_id, {_UNIFIED.format('file_path')} as path from files), r as (select file_id, case when path = 'src' or starts_with(path, 'src\\') then 'source\\main' || substr(path, 4) else path end as path from u)
        select * from r where path is null or not (path = 'lib' or starts_with(path, 'lib\\'))""",
    "tab_upsert": """with f as (select file_path, max(length(code)) as n from files where file_path is not null group by 1), c as (select file_path, n from (select file_path, length(optimized) as n, row_number() over (partition by file_path order by added_at desc, pair_id desc) as k from code_pairs where file_path is not null) where k = 1)
        select file_path, cast(n as int) as n from f where file_path not in (select file_path from c) union all select file_path, cast(n as int) from c""",
    "diag_files": f"""with m as (select distinct file_path, lower({_UNIFIED.format('file_path')}) as m from diagnostics where file_path is not null), f as (select distinct file_path as open_path, lower({_UNIFIED.format('file_path')}) as f from files where file_path is not null),
        fb as (select *, string_split(f, '\\')[-1] as base from f) select file_path, open_path from m join fb on string_split(m, '\\')[-1] = base and (m = f or ends_with(m, '\\' || f) or ends_with(m, '\\' || base))""",
    "line_depths": """with l as (select file_id, unnest(string_split_regex(code, '\\r?\\n')) as text, generate_subscripts(string_split_regex(code, '\\r?\\n'), 1) as line from files where code is not null),
        c as (select file_id, line, unnest(string_split(regexp_replace(text, '[^{}]', '', 'g') || ' ', '')) as c, generate_subscripts(string_split(regexp_replace(text, '[^{}]', '', 'g') || ' ', ''), 1) as i from l),
        s as (select *, sum(case c when '{' then 1 when '}' then -1 else 0 end) over (partition by file_id order by line, i) as s from c), o as (select *, s - least(0, min(s) over (partition by file_id order by line, i)) as d from s),
        e as (select file_id, line, arg_max(d, i) as d from o group by 1, 2) select file_id, count(*) as lines, cast(max(d) as int) as deepest, cast(sum(d) as bigint) as depths from e group by 1""",
    "included_headers": f"""with i as (select file_id, unnest(regexp_extract_all(code, '#include\\s*[<"]([^>"]+)[>"]', 1)) as h from files)
        select distinct file_id, regexp_replace(string_split(h, '/')[-1], '\\.h$', '') as header from i where h <> 'bits/stdc++.h' union select file_id, unnest({symbols.STANDARD_HEADERS}) from i where h = 'bits/stdc++.h'""",
    "heap_running": f"""with {_HEAP}, r as (select event_id, count(*) filter (kind = 'allocate') {_SO_FAR} as allocations, count(*) filter (kind = 'free') {_SO_FAR} as frees, coalesce(sum(amount) filter (kind = 'allocate') {_SO_FAR}, 0) as ba, coalesce(sum(amount) filter (kind = 'free') {_SO_FAR}, 0) as bf,
        count(*) filter (kind = 'allocate' and amount is null) {_SO_FAR} as unknown_allocations, count(*) filter (kind = 'free' and amount is null) {_SO_FAR} as unknown_frees from h)
        select event_id, allocations, frees, greatest(0, allocations - frees) as live, cast(ba as bigint) as bytes_allocated, cast(bf as bigint) as bytes_freed, cast(greatest(0, ba - bf) as bigint) as bytes_live, unknown_allocations, unknown_frees from r""",
    "heap_freed": f"with {_HEAP}, l as (select *, lag(kind) over w as lk, lag(amount) over w as la from h window w as (partition by user_id, name order by ts, event_id)) select event_id, case when lk = 'allocate' then la end as freed from l where kind = 'free'",
    "request_check": """select event_id, case when event_id % 11 = 0 then 'no object' else array_to_string(list_filter([case when event_id % 5 = 0 then 'compiler: out of range' end, case when event_id % 7 = 0 then 'extra: unknown' end,
        case when event_id % 60 not between 1 and 50 then 'runs: out of range' end, case when user_id % 13 > 10 then 'warmupRuns: out of range' end], lambda x: x is not null), '; ') end as problems from events""",
    "argument_merge": f"""with l as (select id, list_concat({ALWAYS}, coalesce(quick_fixes, [])) as xs from error_db), e as (select id, unnest(xs) as argument, unnest(range(len(xs))) as i from l), m as (select id, argument, min(i) as i from e group by 1, 2)
        select id, cast(row_number() over (partition by id order by i) - 1 as int) as place, argument from m""",
    "history_json_tolerant": "select event_id, case when event_id % 5 <> 0 then cast(json_extract(props, '$.k') as int) end as k from events",
    "text_transforms": """with s as (select doc_id, text, regexp_extract_all(text, '(?s)```[A-Za-z+#]*\\r?\\n(.*?)```', 1) as blocks from documents),
        b as (select *, (select arg_max(x, (length(x), -i)) from (select unnest(blocks) as x, generate_subscripts(blocks, 1) as i)) as best from s)
        select doc_id, cast(case when length(text) > 300 then 300 + length('\n...output truncated...') else length(text) end as int) as cut, cast(length(regexp_replace(case when len(blocks) > 0 then best else text end, '^\\s+|\\s+$', '', 'g')) as int) as fenced,
        cast(length(text) - length(replace(text, '(', '')) - (length(text) - length(replace(text, ')', ''))) as int) as brackets, cast(length(replace(replace(replace(replace(replace(replace(text, '<', 'xleftangle'), '>', 'xrightangle'), '{', 'xleftbrace'), '}', 'xrightbrace'), '^', 'xcaret'), '~', 'xtilde')) as int) as escaped from b""",
}
