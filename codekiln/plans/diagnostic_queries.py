"""Compiler messages: parsing, matching, explanations and quick fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.functions import text as t
from codekiln.operators import diagnostics as d
from codekiln.plans.catalog import table


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    """Each message as the log line a compiler would write, one log for each file and compiler, in order."""
    rows = table(spark, folder, "diagnostics").dropDuplicates()
    line = F.concat("file_path", F.lit(":"), "line_no", F.lit(":"), F.coalesce("col_no", F.lit(1)), F.lit(": "), "diag_type", F.lit(": "), "message")
    lines = rows.select("file_id", "compiler", F.struct("diag_id", F.coalesce(line, F.lit("note: nothing")).alias("line")).alias("x"))
    grouped = lines.groupBy("file_id", "compiler").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("file_id", "compiler", F.array_join("xs.line", "\r\n").alias("stderr"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "diagnostics").dropDuplicates()
    return rows.select("diag_id", "compiler", F.lower("diag_type").alias("type"), F.trim("message").alias("message"))


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    return d.match_messages(_messages(spark, folder), table(spark, folder, "error_db"))


def diag_parse(spark: SparkSession, folder: str) -> DataFrame:
    return d.parse_log(_logs(spark, folder), "stderr", ["file_id", "compiler"])


def diag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return diag_parse(spark, folder).groupBy("file", "type").agg(F.count("*").alias("n"), F.countDistinct("message").alias("messages"))


def diag_match(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select("diag_id", "entry_id", "matcher", F.round("score", 9).alias("score"))


def diag_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return d.unmatched(_matched(spark, folder))


def diag_explain(spark: SparkSession, folder: str) -> DataFrame:
    return d.explain(_matched(spark, folder), table(spark, folder, "error_db")).select("diag_id", "severity", "category", "band", "title", "summary")


def quickfix_rank(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "error_db")
    explained = d.explain(_matched(spark, folder), entries)
    return d.quick_fixes(explained, entries, ["diag_id"]).withColumn("relevance", F.round("relevance", 9))


def quickfix_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's messages as fixes: what is left of them once near duplicates are gone."""
    rows = table(spark, folder, "diagnostics").dropDuplicates().filter("file_id is not null and message is not null")
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("diag_id", "message"))).alias("xs"))
    return lists.select("file_id", F.posexplode(d.distinct_fixes(F.col("xs.message"))).alias("kept_no", "message"))


def diag_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "diagnostics")
    return rows.groupBy(d.needs_fallback(F.col("message")).alias("fallback"), d.message_kind(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))


def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text against its path and source."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.round(t.token_overlap(F.col("text"), F.concat_ws(" ", "file_path", "source")), 9).alias("overlap"), F.size(t.unique_tokens(F.col("text"))).alias("words"))


def edit_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of messages of one file and line's compiler output that differ."""
    rows = table(spark, folder, "diagnostics").filter("message is not null").select("file_id", "message").distinct()
    a, b = rows.select("file_id", F.col("message").alias("m1")), rows.select("file_id", F.col("message").alias("m2"))
    pairs = a.join(b, "file_id").filter("m1 < m2")
    return pairs.select("file_id", "m1", "m2", F.round(t.edit_similarity(F.col("m1"), F.col("m2")), 9).alias("similarity"))


def first_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "error_db").select("id", t.first_sentence(F.concat_ws(" ", "explanation", "title")).alias("summary"), t.as_sentence(F.element_at("quick_fixes", 1)).alias("fix"))


QUERIES = [diag_parse, diag_counts, diag_match, diag_unmatched, diag_explain, quickfix_rank, quickfix_dedupe, diag_fallback, token_overlap, edit_similarity, first_sentence]

def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(string_split({_norm(x)}, ' ')), lambda w: w <> '')"


def _overlap(a: str, b: str) -> str:
    left, right = _tokens(a), _tokens(b)
    return f"(case when len({left}) = 0 or len({right}) = 0 then 0.0::double else len(list_intersect({left}, {right}))::double / greatest(len({left}), len({right})) end)"


def _similar(a: str, b: str) -> str:
    left, right = _norm(a), _norm(b)
    return f"(case when greatest(length({left}), length({right})) = 0 then 1.0::double else 1 - levenshtein({left}, {right})::double / greatest(length({left}), length({right})) end)"


_LINES = """lines as (select file_id, compiler, diag_id, coalesce(file_path || ':' || line_no || ':' || coalesce(col_no, 1) || ': ' || diag_type || ': ' || message, 'note: nothing') as line from (select distinct * from diagnostics)),
    numbered as (select *, row_number() over (partition by file_id, compiler order by diag_id, line) - 1 as log_line from lines)"""
_PARSED = """select file_id, compiler, cast(log_line as int) as log_line, regexp_extract(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$', 1) as file,
    cast(regexp_extract(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$', 2) as int) as line, cast(regexp_extract(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$', 3) as int) as "column",
    lower(regexp_extract(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$', 4)) as type, regexp_extract(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$', 5) as message
    from numbered where regexp_matches(line, '(?i)^(.+?):(\\d+):(\\d+):\\s*(warning|error):\\s*(.+)$')"""
_MATCHED = f"""msgs as (select diag_id, compiler, lower(diag_type) as type, trim(message) as message from (select distinct * from diagnostics)),
    known as (select distinct compiler, type, message from msgs where message is not null),
    base as (select k.*, e.id, e.ordinal, e.message_pattern as p, regexp_matches(k.message, e.message_pattern, 'i') as hit,
        {_overlap('e.message_pattern', 'k.message')} as ov, {_similar('e.message_pattern', 'k.message')} as sim from known k join error_db e on k.compiler = e.compiler and k.type = e.diag_type),
    scored as (select *, case when hit then least(0.99::double, 0.72::double + least(0.2::double, length(p)::double / 180) + ov * 0.12::double + sim * 0.08::double)
        when ov * 0.68::double + sim * 0.32::double >= 0.5 then least(0.8::double, 0.42::double + (ov * 0.68::double + sim * 0.32::double) * 0.5::double) end as score from base),
    best as (select * from (select *, row_number() over (partition by compiler, type, message order by score desc, ordinal) as k from scored where score is not null) where k = 1),
    matched as (select m.*, coalesce(b.id, 'generic.error') as entry_id, case when b.id is null then 'fallback' when b.hit then 'regex' else 'fuzzy' end as matcher, coalesce(b.score, 0.25) as score
        from msgs m left join best b on m.compiler = b.compiler and m.type = b.type and m.message = b.message)"""
_SUMMARY = "upper(x[1]) || x[2:]"
_ACTION = "case when regexp_matches(n, 'add|remove|replace|change|convert|declare|include|pass|use|move|keep|provide|adjust|define|link|compile|cast') then 'edit' when regexp_matches(n, 'check|verify|confirm|inspect|ensure|review|trace') then 'check' when regexp_matches(n, 'read|open|consult|reference|documentation|docs') then 'read' else 'check' end"

_SAME = f"({_norm('y')} = '' or {_norm('x[1]')} = '' or {_norm('y')} = {_norm('x[1]')} or {_overlap('y', 'x[1]')} >= 0.8 or {_similar('y', 'x[1]')} >= 0.86)"

SQL = {
    "quickfix_dedupe": f"""with r as (select file_id, diag_id, message, trim(regexp_replace(message, '\\s+', ' ', 'g')) as c from (select distinct * from diagnostics where file_id is not null and message is not null)),
        q as (select file_id, diag_id, message, upper(c[1]) || c[2:] || case when regexp_matches(c, '[.!?]$') then '' else '.' end as fix from r where c <> ''), l as (select file_id, list([fix] order by diag_id, message) as xs from q group by file_id),
        k as (select file_id, list_reduce(xs, lambda kept, x: case when len(list_filter(kept, lambda y: {_SAME})) > 0 then kept else list_concat(kept, x) end) as kept from l)
        select file_id, cast(unnest(range(len(kept))) as int) as kept_no, unnest(kept) as message from k""",
    "diag_parse": f"with {_LINES} {_PARSED}",
    "diag_counts": f"with {_LINES}, p as ({_PARSED}) select file, type, count(*) as n, count(distinct message) as messages from p group by file, type",
    "diag_match": f"with {_MATCHED} select diag_id, entry_id, matcher, round(score, 9) as score from matched",
    "diag_unmatched": f"with {_MATCHED} select compiler, type, message, count(*) as times from matched where matcher = 'fallback' group by all",
    "diag_explain": f"""with {_MATCHED}, j as (select m.*, coalesce(e.title, 'Unknown diagnostic') as title, trim(regexp_replace(coalesce(nullif(trim(e.explanation), ''), nullif(trim(m.message), ''), coalesce(e.title, 'Unknown diagnostic')), '\\s+', ' ', 'g')) as src from matched m left join error_db e on m.entry_id = e.id),
        s as (select *, case when regexp_matches(src, '^.*?[.!?]\\s') then rtrim(regexp_extract(src, '^(.*?[.!?])\\s', 1)) else src end as x from j)
        select diag_id, case when type = 'error' then 'HIGH' else 'MEDIUM' end as severity, 'General' as category, case when score >= 0.85 then 'high' when score >= 0.6 then 'medium' else 'low' end as band, title, {_SUMMARY} as summary from s""",
    "quickfix_rank": f"""with {_MATCHED}, f as (select id, unnest(quick_fixes) as raw, generate_subscripts(quick_fixes, 1) - 1 as ordinal from error_db),
        t as (select id, ordinal, case when regexp_matches(s, '[.!?]$') then s else s || '.' end as fix from (select id, ordinal, upper(c[1]) || c[2:] as s from (select id, ordinal, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as c from f))),
        a as (select t.*, {_ACTION.replace('(n,', '(' + _norm('fix') + ',')} as action from t),
        r as (select m.diag_id, m.matcher, m.type, a.*, least(0.99::double, 0.38::double + {_overlap('a.fix', 'm.message')} * 0.3::double + 0.0::double * 0.2::double + case a.action when 'edit' then 0.16::double when 'check' then 0.1::double else 0.04::double end
            + case m.matcher when 'regex' then 0.08::double when 'fuzzy' then 0.05::double else 0.0::double end + case when m.type = 'error' then 0.08::double else 0.04::double end) as relevance from matched m join a on m.entry_id = a.id),
        k as (select *, row_number() over (partition by diag_id order by relevance desc, ordinal) as priority from r)
        select diag_id, cast(priority as int) as priority, 'fix-' || priority as fix_id, fix, action, case when action = 'edit' then case when type = 'error' then 'HIGH' else 'MEDIUM' end when action = 'check' then 'MEDIUM' else 'LOW' end as impact, round(relevance, 9) as relevance from k where priority <= 5""",
    "diag_fallback": """select coalesce(regexp_matches(message, '(?i)crtdbg\\.h|vs\\.h|yvals_core\\.h|cannot open source file|__builtin_verbose_trap|STL1000.*Clang'), false) as fallback,
        case when contains(lower(message), 'undefined reference') then 'linker-error' when contains(lower(message), 'no matching function') then 'type-signature-error' else 'general-diagnostic' end as kind, count(*) as n from diagnostics group by 1, 2""",
    "token_overlap": f"select doc_id, round({_overlap('text', chr(34) + 'fs' + chr(34))}, 9) as overlap, cast(len({_tokens('text')}) as int) as words from (select *, concat_ws(' ', file_path, source) as fs from documents)",
    "edit_similarity": f"with r as (select distinct file_id, message from diagnostics where message is not null) select a.file_id, a.message as m1, b.message as m2, round({_similar('a.message', 'b.message')}, 9) as similarity from r a join r b on a.file_id = b.file_id and a.message < b.message",
    "first_sentence": """select id, case when regexp_matches(s, '[.!?]\\s') then regexp_extract(s, '^(.*?[.!?])\\s', 1) else s end as summary, case when regexp_matches(f, '[.!?]$') then upper(f[1]) || f[2:] else upper(f[1]) || f[2:] || '.' end as fix
        from (select id, trim(regexp_replace(concat_ws(' ', explanation, title), '\\s+', ' ', 'g')) as s, trim(regexp_replace(quick_fixes[1], '\\s+', ' ', 'g')) as f from error_db)""",
}
