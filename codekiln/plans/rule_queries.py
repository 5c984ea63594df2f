"""Text features, risk, rules, templates and recommendations."""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.functions.text import html_escaped, percent_text
from codekiln.operators import recommend as rec
from codekiln.operators import risk_model as m
from codekiln.operators import rules as r
from codekiln.operators import templates as tpl
from codekiln.operators import text_features as tf
from codekiln.plans.catalog import table
from codekiln.sources.dimensions import _DATA, load_algorithms, load_rules, load_templates

# Fixed values of this catalogue: importances of a model that is not fitted here.
WEIGHTS = {"loops_total": 0.3, "nesting_max_depth": 0.25, "alloc_total": 0.15, "recursion_count": 0.1, "pointers_total": 0.08, "stl_total": 0.07, "function_count": 0.05}
MEANS = {"loops_total": 3.0, "nesting_max_depth": 2.5, "alloc_total": 1.5, "recursion_count": 0.5, "pointers_total": 6.0, "stl_total": 8.0, "function_count": 3.5}
METRICS = ["loops_total", "nesting_max_depth", "recursion_count", "alloc_total", "stl_container_refs", "stl_algorithm_calls", "stl_iterator_usage", "stl_total"]
SIMPLE = [c for c in tf.FEATURE_COLUMNS if not c.startswith("code_smell")]


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return tf.text_features(table(spark, folder, "files"), "file_id", "code")


def feature_text(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select("file_id", *SIMPLE)


def brace_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Of both texts of every pair."""
    pairs = table(spark, folder, "code_pairs").select("pair_id", F.explode(F.array("unoptimized", "optimized")).alias("code")).filter("code is not null")
    return pairs.select("pair_id", tf.brace_depth(F.col("code")).alias("depth")).groupBy("depth").agg(F.count("*").alias("texts"))


def func_names_recursion(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files").filter("code is not null")
    names = tf.function_names(F.col("code"))
    return files.select("file_id", F.array_join(F.array_sort(names), ",").alias("names"), tf.recurring_names(F.col("code"), names).alias("recurring"))


def long_function_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").filter("code is not null").select("file_id", tf.long_functions(F.col("code")).alias("long_functions"))


def risk_label(spark: SparkSession, folder: str) -> DataFrame:
    """Smells aside, which SQL can't count."""
    rows = _features(spark, folder).withColumn("code_smell_high_severity_count", F.lit(0.0))
    return tf.with_risk(rows).select("file_id", F.round("risk_score", 6).alias("risk_score"), "risk_label")


def feature_means(spark: SparkSession, folder: str) -> DataFrame:
    means = m.feature_means(_features(spark, folder), SIMPLE)
    return means.select(*[F.round(c, 6).alias(c) for c in SIMPLE])


def top_causes(spark: SparkSession, folder: str) -> DataFrame:
    return m.top_causes(_features(spark, folder), "file_id", WEIGHTS, MEANS).withColumn("contribution", F.round("contribution", 9))


def rf_risk_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The forest on files and synthetic rows, and what it says of the files."""
    files = _features(spark, folder)
    rows = m.training_rows(files, m.synthetic_rows(spark, 480))
    model = m.fit_forest(rows, "risk_label")
    return m.predict(model, files, "file_id").select("file_id", "predicted", percent_text(F.col("probability")).alias("percent"))


def train_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    split = m.stratified_split(table(spark, folder, "code_pairs").select("pair_id", "performance_risk"), "pair_id", "performance_risk")
    return split.groupBy("performance_risk", "is_test").agg(F.count("*").alias("n"))


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    """Compiler messages of files as findings of the checks."""
    rows = table(spark, folder, "diagnostics").filter("file_id is not null").dropDuplicates()
    kinds = F.array(*[F.lit(x) for x in ("memory_risk", "copy_hotspot", "unused_variable", "dead_code")])
    return rows.select("file_id", F.element_at(kinds, (F.col("diag_id") % 4 + 1).cast("int")).alias("check_type"), F.when(F.lower("diag_type") == "error", "high").when(F.col("col_no").isNull(), "other").otherwise("LOW").alias("severity"), (F.col("diag_id") % 3).alias("k"))


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    issues = _issues(spark, folder)
    smells = issues.filter("k = 0").select("file_id", F.when(F.col("check_type") == "dead_code", "magic_numbers").otherwise("long_function").alias("smell_type"))
    return r.rule_inputs(_features(spark, folder), issues, smells, METRICS)


def severity_pressure(spark: SparkSession, folder: str) -> DataFrame:
    return _inputs(spark, folder).select("file_id", F.round("pressure", 9).alias("pressure"), F.round("density", 9).alias("density"))


def rule_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.match_rules(_inputs(spark, folder), load_rules(spark))
    return rows.select("file_id", F.col("rule.id").alias("rule_id"), F.round("matched_weight", 9).alias("matched_weight"), F.round("preliminary", 9).alias("preliminary"), F.size("hints").alias("hints"))


def rule_calibrate_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = r.rank_suggestions(r.match_rules(_inputs(spark, folder), load_rules(spark)))
    return rows.select("file_id", "rule_id", F.round("confidence", 9).alias("confidence"), "band", F.round("score", 9).alias("score"), "rank")


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    return r.metrics_long(_features(spark, folder), METRICS)


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    rows = tf.with_risk(_features(spark, folder).withColumn("code_smell_high_severity_count", F.lit(0.0))).join(_inputs(spark, folder).select("file_id", F.coalesce(F.element_at("checks", F.lit("memory_risk")), F.lit(0.0)).alias("memory")), "file_id")
    whole = lambda c: F.col(c).cast("int").cast("string")
    context = F.create_map(*[x for k, v in (("file", F.col("file_id")), ("risk_class", F.col("risk_label")), ("nesting", whole("nesting_max_depth")), ("loops", whole("loops_total")), ("memory", whole("memory")), ("top", F.lit("loops"))) for x in (F.lit(k), v)])
    return rows.select(F.col("file_id").alias("key"), context.alias("context"))


def template_render(spark: SparkSession, folder: str) -> DataFrame:
    return tpl.select_templates(_contexts(spark, folder), load_templates(spark)).select(F.col("key").alias("file_id"), "template_id", "rank", "title", "summary")


def action_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return tpl.merged_actions(tpl.select_templates(_contexts(spark, folder), load_templates(spark)))


def keyword_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return rec.recommend(table(spark, folder, "documents"), "doc_id", "text", load_algorithms(spark))


def html_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(html_escaped(F.col("text"))).alias("digest"))


QUERIES = [feature_text, brace_depth, func_names_recursion, long_function_lines, risk_label, feature_means, top_causes, rf_risk_fit, train_stratified_split, severity_pressure, rule_match, rule_calibrate_rank, metrics_long, template_render, action_dedupe, keyword_recommend, html_texts]


def _count(pattern: str) -> str:
    plain = pattern.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b")
    return f"len(regexp_extract_all(plain, '{plain}'))"


_HEAD = tf.FUNCTION_HEAD.replace("(?<![A-Za-z0-9_])", "\\b")
_NAMES = f"list_filter(list_distinct(regexp_extract_all(code, '{_HEAD}', 1)), lambda n: n not in ('if', 'while', 'for', 'switch', 'catch', 'else'))"
_RECURRING = "len(list_filter(names, lambda n: len(regexp_extract_all(code, concat('\\b', n, '\\s*\\('))) >= 2))"


def _depths(source: str, key: str) -> str:
    """The deepest point as the running sum less its least value so far, which is what holding at 0 comes to."""
    return f"""chars as (select {key}, unnest(string_split(regexp_replace(code, '[^{{}}]', '', 'g'), '')) as c, generate_subscripts(string_split(regexp_replace(code, '[^{{}}]', '', 'g'), ''), 1) as i from {source}),
    sums as (select {key}, i, sum(case c when '{{' then 1 when '}}' then -1 else 0 end) over (partition by {key} order by i) as s from chars),
    lows as (select {key}, s - least(0, min(s) over (partition by {key} order by i)) as open from sums), depths as (select {key}, greatest(0, max(open)) as depth from lows group by {key})"""


_FEATURES = f"""src as (select file_id, coalesce(code, '') as code, regexp_replace(coalesce(code, ''), '{tf.OTHER_LETTERS}', 'x', 'g') as plain from files), {_depths('src', 'file_id')},
    f0 as (select s.file_id, s.code, {_NAMES} as names, cast(coalesce(d.depth, 0) as int) as nesting_max_depth, {', '.join(f'{_count(p)} as {n}' for n, p in tf.PATTERNS.items())} from src s left join depths d using (file_id)),
    f1 as (select *, {_RECURRING} as recursion_count, len(names) as function_count, for_all + loops_while + loops_do_while as loops_total, greatest(0, for_all - loops_range_for) as loops_for,
        pointers_declarations + pointers_dereferences + pointers_address_of as pointers_total, stl_container_refs + stl_algorithm_calls + stl_iterator_usage as stl_total,
        alloc_heap_new + alloc_heap_delete + alloc_malloc_family + alloc_free_calls + alloc_stack_arrays as alloc_total, semantic_high_severity_count + void_pointers as semantic_issue_count from f0),
    f2 as (select *, case when nesting_max_depth >= 5 or loops_total >= 6 then 6 when nesting_max_depth >= 3 or loops_total >= 3 then 4 when loops_total >= 1 then 2 else 1 end as complexity_time_rank,
        least(6, greatest(1, nesting_max_depth // 2 + recursion_count)) as complexity_space_rank from f1),
    f as (select file_id, {', '.join(f'cast({c} as double) as {c}' for c in SIMPLE)} from f2)"""
_RISK = "rk as (select *, loops_total * 1.4::double + nesting_max_depth * 2.2::double + recursion_count * 3.0::double + alloc_total * 1.8::double + complexity_time_rank * 2.5::double + semantic_high_severity_count * 2.0::double as score from f), rl as (select *, case when score >= 28 then 'risk_high' when score >= 16 then 'risk_medium' else 'risk_low' end as label from rk)"
_ISSUES = """iss as (select file_id, (['memory_risk', 'copy_hotspot', 'unused_variable', 'dead_code'])[diag_id % 4 + 1] as check_type, case when lower(diag_type) = 'error' then 'HIGH' when col_no is null then 'OTHER' else 'LOW' end as severity, diag_id % 3 as k from (select distinct * from diagnostics) where file_id is not null),
    sme as (select file_id, case when check_type = 'dead_code' then 'magic_numbers' else 'long_function' end as smell_type from iss where k = 0),
    press as (select file_id, least(1, sum(case severity when 'HIGH' then 1.0::double when 'LOW' then 0.35::double else 0.5::double end) / 8) as pressure from iss group by 1), dens as (select file_id, least(1, count(*)::double / 5) as density from sme group by 1),
    inp as (select f.*, coalesce(pressure, 0) as pressure, coalesce(density, 0) as density from f left join press using (file_id) left join dens using (file_id))"""


@lru_cache
def _json(name: str) -> list | dict:
    with open(os.path.join(_DATA, f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def _text(x: object) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::double"


def _rules() -> str:
    rules, conditions = [], []
    for k, rule in enumerate(_json("rules")):
        rules.append(f"({_text(rule['id'])}, {_text(rule['category'])}, {rule['priority']}::double, {rule['base_confidence']}::double, {rule['max_confidence']}::double, {rule.get('stl_signal_weight', 0.08)}::double, {k})")
        for c in rule["conditions"]:
            conditions.append(f"({_text(rule['id'])}, {_text(c['type'])}, {_text(c.get('metric_path') or c.get('check_type') or c.get('smell_type'))}, {_text(c['operator'])}, {c['value']}::double, {c.get('weight', 0.15)}::double, {_text(c.get('required', True))}, {_text(bool((c.get('hint') or '').strip()))})")
    return f"ru(rule_id, category, priority, base, most, w, ordinal) as (values {', '.join(rules)}), co(rule_id, type, name, op, value, weight, required, hint) as (values {', '.join(conditions)})"


_MATCH = f"""{_rules()}, longf as (unpivot (select file_id, {', '.join(METRICS)} from f) on {', '.join(METRICS)} into name name value v),
    cv as (select i.file_id, co.*, case co.type when 'metric_threshold' then l.v when 'semantic_count' then (select count(*) from iss where iss.file_id = i.file_id and iss.check_type = co.name) else (select count(*) from sme where sme.file_id = i.file_id and sme.smell_type = co.name) end as v
        from inp i cross join co left join longf l on l.file_id = i.file_id and l.name = co.name and co.type = 'metric_threshold'),
    ok as (select *, coalesce(case op when '>=' then v >= value when '>' then v > value when '<=' then v <= value when '<' then v < value else v = value end, false) as passed from cv),
    ag as (select file_id, rule_id, sum(case when passed then weight else 0 end) as matched_weight, sum(weight) as possible, cast(count(*) filter (passed and hint) as int) as hints from ok group by 1, 2 having bool_and(passed or not required)),
    pr as (select ag.*, ru.category, ru.priority, ru.most, ru.ordinal, inp.pressure, inp.density, case when ru.category = 'stl' then least(0.15::double, ru.w * (least(1, stl_total / 8) * 0.5::double + least(1, stl_container_refs / 4) * 0.2::double + least(1, stl_algorithm_calls / 3) * 0.2::double + least(1, stl_iterator_usage / 3) * 0.1::double)) else 0 end as boost, ru.base
        from ag join ru using (rule_id) join inp using (file_id)),
    pm as (select *, least(most, greatest(0, base + matched_weight + boost)) as preliminary from pr)"""


def _filled(text: str) -> str:
    fill = {"file": "file_id", "nesting": "nesting", "loops": "loops", "memory": "memory", "top": "'loops'"}
    return "concat('', " + ", ".join(fill.get(x, "''") if j % 2 else _text(x) for j, x in enumerate(text.replace("}}", "{{").split("{{"))) + ")"


def _templates() -> str:
    rows = []
    for k, t in enumerate(_json("templates")["templates"]):
        conditions = [f"cast({p.removesuffix('.min')} as double) >= {v}" if p.endswith(".min") else f"{p} = '{v}'" for p, v in t["when"].items()]
        actions = "[" + ", ".join(map(_filled, t["actions"])) + "]::varchar[]"
        rows.append(f"select file_id, '{t['id']}' as template_id, {t['priority']} as priority, {k} as ordinal, '{t['title']}' as title, {_filled(t['summary'])} as summary, {actions} as actions from ctx where {' and '.join(conditions) or 'true'}")
    return " union all ".join(rows)


_CONTEXT = "ctx as (select rl.file_id, rl.label as risk_class, cast(rl.nesting_max_depth as int) as nesting, cast(rl.loops_total as int) as loops, (select count(*) from iss where iss.file_id = rl.file_id and check_type = 'memory_risk') as memory from rl)"


def _terms() -> str:
    rows = [f"('{a['name']}', '{t}', {w})" for a in _json("algorithms")["algorithms"] for w, key in ((2, "keywords"), (1, "categories")) for t in a[key]]
    return f"terms(name, term, weight) as (values {', '.join(rows)})"


_LINE_WITH_HEAD = tf.LINE_WITH_HEAD.replace("(?<![A-Za-z0-9_])", "\\b")
SQL = {
    "long_function_lines": f"""with l as (select file_id, unnest(string_split(code, '\n')) as s, unnest(range(len(string_split(code, '\n')))) as k from files where code is not null),
        h as (select file_id, k, cast(regexp_matches(s, '{_LINE_WITH_HEAD}') as int) as head, length(s) - length(replace(s, '{{', '')) - (length(s) - length(replace(s, '}}', ''))) as change from l),
        g as (select *, sum(head) over (partition by file_id order by k) as no from h), c as (select *, sum(change) over (partition by file_id, no order by k) as open, min(k) over (partition by file_id, no) as start from g where no > 0),
        e as (select file_id, no, min(k - start) as below from c where k > start and open <= 0 group by 1, 2)
        select f.file_id, cast(count(e.no) as int) as long_functions from (select file_id from files where code is not null) f left join e on e.file_id = f.file_id and below > 40 group by 1""",
    "feature_text": f"with {_FEATURES} select * from f",
    "brace_depth": f"with src as (select row_number() over () as k, code from (select unoptimized as code from code_pairs union all select optimized from code_pairs) where code is not null), {_depths('src', 'k')} select cast(coalesce(d.depth, 0) as int) as depth, count(*) as texts from src left join depths d using (k) group by 1",
    "func_names_recursion": f"select file_id, array_to_string(list_sort(names), ',') as names, cast({_RECURRING} as int) as recurring from (select file_id, code, {_NAMES} as names from files where code is not null)",
    "risk_label": f"with {_FEATURES}, {_RISK} select file_id, round(score, 6) as risk_score, label as risk_label from rl",
    "feature_means": f"with {_FEATURES} select {', '.join(f'round(avg({c}), 6) as {c}' for c in SIMPLE)} from f",
    "top_causes": f"""with {_FEATURES}, c as (select file_id, unnest([{', '.join(f"struct_pack(feature := '{c}', k := {k}, value := {c}, contribution := {w}::double * (1 + abs({c} - {MEANS[c]}::double)))" for k, (c, w) in enumerate(WEIGHTS.items()))}], recursive := true) from f),
        r as (select *, row_number() over (partition by file_id order by contribution desc, k) as n from c) select file_id, cast(n as int) as cause_no, feature, value, round(contribution, 9) as contribution from r where n <= 5""",
    "train_stratified_split": """with n as (select performance_risk, count(*) as n from code_pairs group by 1), t as (select performance_risk, n, cast(floor(n * 0.2::double + 0.5) as bigint) as k from n)
        select performance_risk, true as is_test, k as n from t where k > 0 union all select performance_risk, false, n - k from t where n > k""",
    "severity_pressure": f"with {_FEATURES}, {_ISSUES} select file_id, round(pressure, 9) as pressure, round(density, 9) as density from inp",
    "rule_match": f"with {_FEATURES}, {_ISSUES}, {_MATCH} select file_id, rule_id, round(matched_weight, 9) as matched_weight, round(preliminary, 9) as preliminary, hints from pm",
    "rule_calibrate_rank": f"""with {_FEATURES}, {_ISSUES}, {_MATCH},
        ca as (select *, least(1, greatest(0, least(most, preliminary * 0.8::double + (case when possible > 0 then least(1, matched_weight / possible) else 0 end) * 0.15::double + least(1, boost / 0.15::double) * 0.03::double + pressure * 0.01::double + density * 0.005::double))) as confidence from pm)
        select file_id, rule_id, round(confidence, 9) as confidence, case when confidence >= 0.85 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as band, round(confidence + priority / 100, 9) as score,
        cast(row_number() over (partition by file_id order by confidence + priority / 100 desc, ordinal) as int) as rank from ca""",
    "metrics_long": f"with {_FEATURES} unpivot (select file_id, {', '.join(METRICS)} from f) on {', '.join(METRICS)} into name metric_path value value",
    "template_render": f"with {_FEATURES}, {_RISK}, {_ISSUES}, {_CONTEXT}, r as ({_templates()}) select file_id, template_id, cast(row_number() over (partition by file_id order by priority desc, ordinal) as int) as rank, title, summary from r",
    "action_dedupe": f"""with {_FEATURES}, {_RISK}, {_ISSUES}, {_CONTEXT}, drafts as ({_templates()}), ranked as (select *, row_number() over (partition by file_id order by priority desc, ordinal) as rank from drafts),
        listed as (select file_id, rank, unnest(actions) as action, unnest(range(len(actions))) as no from ranked), once as (select *, row_number() over (partition by file_id, lower(trim(action)) order by rank, no) as k from listed where trim(action) <> ''),
        numbered as (select file_id as key, cast(row_number() over (partition by file_id order by rank, no) as int) as action_no, action from once where k = 1) select * from numbered where action_no <= 6""",
    "keyword_recommend": f"""with {_terms()}, w as (select doc_id, lower(text) as text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as words from documents where text is not null)
        select doc_id, name, cast(sum(weight) as bigint) as score from w join terms on case when contains(term, ' ') then contains(text, term) else list_contains(words, term) end group by doc_id, name""",
    "html_texts": "select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as digest from documents",
}
