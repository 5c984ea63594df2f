"""Queries of the training-data operators over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codekiln.llm.answers import is_blank, is_empty_answer
from codekiln.llm.bpe import encode_corpus, load_merges, token_counts
from codekiln.llm.cross_split import CrossSplitParams, class_report, cross_split_links, cross_split_overlaps
from codekiln.llm.formatting_duplicates import collapse_records, repeats
from codekiln.llm.mixing import Mix, mix_sources
from codekiln.llm.near_duplicates import NearDuplicateParams, NearDuplicates, group_rows, near_duplicates, row_pairs
from codekiln.llm.pair_defects import pair_defects
from codekiln.llm.sentences import sentence_units
from codekiln.llm.splitting import split_texts
from codekiln.llm.syntax import error_rates, syntax_errors
from codekiln.plans.catalog import table

FIELDS = ["unoptimized", "optimized"]
#: TESTDATA.md fixes runs of four words and these thresholds.
NEAR = NearDuplicateParams(words=4, threshold=0.6)
CROSS = CrossSplitParams(words=4, threshold=0.8)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "code_pairs"), "pair_id", FIELDS).filter("piece_no = 1").select("pair_id", "field_name")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "code_pairs"), "pair_id", FIELDS)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """code_pairs with answers that say nothing, given a prompt, as null: they are no files."""
    pairs = table(spark, folder, "code_pairs").select("pair_id", "repo", "file_path", "unoptimized", "optimized")
    said_nothing = is_empty_answer(F.col("optimized")) & ~is_blank(F.col("unoptimized"))
    return pairs.withColumn("optimized", F.when(~said_nothing, F.col("optimized")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = syntax_errors(_files(spark, folder), "pair_id", "file_path", FIELDS)
    return found.filter("checked and error_line is not null").select("pair_id", "field_name")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return error_rates(files, syntax_errors(files, "pair_id", "file_path", FIELDS), "pair_id", "repo")


def p4_defects(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects(table(spark, folder, "code_pairs"), "pair_id", "unoptimized", "optimized")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_defects(spark, folder).filter("defect is not null")


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    return near_duplicates(table(spark, folder, "code_pairs"), "pair_id", "unoptimized", NEAR)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return row_pairs(_near(spark, folder), NEAR.expand)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return group_rows(_near(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_overlaps(table(spark, folder, "code_pairs"), "pair_id", "unoptimized", "split", CROSS).selectExpr("least(train_id, eval_id) as pair_id_1", "greatest(train_id, eval_id) as pair_id_2")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "code_pairs")
    return class_report(pairs, cross_split_links(pairs, "pair_id", "unoptimized", "split", CROSS), "pair_id", "split", "source", "performance_risk")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(collapse_records(table(spark, folder, "pair_lines"), "line_id", "raw", "unoptimized"))


def p7_sets(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_records(table(spark, folder, "pair_lines"), "line_id", "raw", "unoptimized").sets.selectExpr("first_id as line_id", "copies")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", load_merges())


def _mix(spark: SparkSession, folder: str) -> Mix:
    docs = table(spark, folder, "documents")
    return mix_sources(docs, token_counts(docs, "doc_id", "text", load_merges()), table(spark, folder, "mix_targets"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).documents


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_units(table(spark, folder, "documents"), "doc_id", "text", with_text=False).select("doc_id", "start_at", "end_at")


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_units(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_rates, p4_found, p4_defects, p5_found, p5_groups, p6_found, p6_report, p7_found, p7_sets, p8_ids, p9_documents, p9_shares, p10_found, p10_sentences)}


_SHINGLES = r"""words as (select pair_id, regexp_extract_all(lower(unoptimized), '[\p{L}\p{N}_]+') as w from code_pairs where unoptimized is not null),
    numbered as (select pair_id, w, unnest(range(1, len(w) - 2)) as i from words where len(w) >= 4),
    shingles as (select distinct pair_id, array_to_string(w[i : i + 3], ' ') as s from numbered),
    sizes as (select pair_id, count(*) as n from shingles group by pair_id),
    shared as (select a.pair_id as pair_id_1, b.pair_id as pair_id_2, count(*) as c from shingles a join shingles b on a.s = b.s and a.pair_id < b.pair_id group by 1, 2),
    likeness as (select pair_id_1, pair_id_2, c / (x.n + y.n - c) as l from shared join sizes x on x.pair_id = pair_id_1 join sizes y on y.pair_id = pair_id_2)"""
_SIDES = """sides as (select pair_id, source, performance_risk, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('validation', 'valid', 'val', 'dev') then 'validation' when lower(trim(split)) in ('test', 'testing') then 'test' end as side from code_pairs),
    met as (select pair_id_1, pair_id_2, case when a.side = 'train' then pair_id_1 else pair_id_2 end as train_id, case when a.side = 'train' then pair_id_2 else pair_id_1 end as eval_id
        from likeness join sides a on a.pair_id = pair_id_1 join sides b on b.pair_id = pair_id_2 where l >= 0.8 and (a.side = 'train') <> (b.side = 'train') and a.side is not null and b.side is not null)"""
_RECORDS = r"""said as (select line_id, case when json_valid(raw) and json_type(raw) = 'OBJECT' then json_extract_string(raw, '$.unoptimized') end as text from pair_lines),
    plain as (select line_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as own from said where text is not null),
    sets as (select own, min(line_id) as first_id, count(*) as copies from plain where own <> '' group by own)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": " union all ".join(f"select pair_id, '{f}' as field_name from code_pairs where strlen({f}) > 3000" for f in FIELDS),
        "p5_found": f"with {_SHINGLES} select pair_id_1, pair_id_2 from likeness where l >= 0.6",
        "p5_groups": f"""with recursive {_SHINGLES}, named as (select pair_id, md5(string_agg(s, '|' order by s)) as set_name from shingles group by 1), classes as (select pair_id, min(pair_id) over (partition by set_name) as class_id from named),
            linked as (select distinct x.class_id as a, y.class_id as b from likeness join classes x on x.pair_id = pair_id_1 join classes y on y.pair_id = pair_id_2 where l >= 0.6 and x.class_id <> y.class_id), ways as (select a, b from linked union select b, a from linked),
            reached(rep, id) as (select class_id, class_id from classes union select rep, b from reached join ways on id = a), groups as (select rep, min(id) as group_id from reached group by 1), counted as (select a, count(*) as links from ways group by 1)
            select pair_id, class_id, group_id, coalesce(links, 0) as links from classes join groups on rep = class_id left join counted on a = class_id""",
        "p6_found": f"with {_SHINGLES}, {_SIDES} select pair_id_1, pair_id_2 from met",
        "p6_report": f"""with {_SHINGLES}, {_SIDES}, links as (select o.eval_id, count(*) as links, count(*) filter (t.performance_risk = e.performance_risk) as agree, count(*) filter (t.performance_risk is null or e.performance_risk is null) as unlabelled
            from met o join sides t on t.pair_id = train_id join sides e on e.pair_id = eval_id group by 1)
            select side as split, source, count(*) as rows, count(links) as overlapping_rows, cast(coalesce(sum(links), 0) as bigint) as links, cast(coalesce(sum(agree), 0) as bigint) as agreeing_links, cast(coalesce(sum(unlabelled), 0) as bigint) as unlabelled_links
            from sides left join links on eval_id = pair_id where side in ('validation', 'test') group by side, source""",
        "p7_found": f"with {_RECORDS} select first_id as line_id_1, line_id as line_id_2 from plain join sets using (own) where line_id <> first_id",
        "p7_sets": f"with {_RECORDS} select first_id as line_id, copies from sets",
    }
