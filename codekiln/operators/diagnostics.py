"""Compiler messages: parsing, matching with the error database, ranked quick fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.functions.score import band, fuzzy_match_score, quick_fix_relevance, regex_match_score
from codekiln.functions.text import action_of, as_sentence, category_of, category_words, edit_similarity, first_sentence, impact_of, normalized, sentence_case, severity_of, token_overlap, unique_tokens
from codekiln.operators.skew import salted_join

# Fixed value: a message of the compilers; notes and fatal errors don't match.
MESSAGE_LINE = r"(?i)^(.+?):(\d+):(\d+):\s*(warning|error):\s*(.+)$"
# Signs in the output of a compiler that another one should be tried.
FALLBACK_SIGNS = [r"crtdbg\.h", r"vs\.h", r"yvals_core\.h", r"cannot open source file", r"__builtin_verbose_trap", r"STL1000.*Clang"]


def parse_log(logs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, log_line (from 0), file, line, column, type, message of every line of a log that is an error or a warning.

    Lines end with \\n or \\r\\n. Null logs have none; a number too large for an int is null.
    """
    lines = logs.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("log_line", "entry")).filter(F.col("entry").rlike(MESSAGE_LINE))
    part = lambda k: F.regexp_extract("entry", MESSAGE_LINE, k)
    return lines.select(*keep, "log_line", part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("column"), F.lower(part(4)).alias("type"), part(5).alias("message"))


def needs_fallback(output: Column) -> Column:
    return F.coalesce(output.rlike("(?i)" + "|".join(FALLBACK_SIGNS)), F.lit(False))


def match_messages(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """messages (compiler, type, message and others) with entry_id, matcher and score of the best entry.

    Entries (id, compiler, diag_type, message_pattern, ordinal) fit by compiler and
    type; a pattern that matches counts before a fuzzy likeness, and the entry of the
    best score wins, the one of lower ordinal on a tie. A message without any has
    matcher fallback and score .25. Messages are matched once however often they
    were logged; null messages fall back.
    """
    known = messages.select("compiler", "type", "message").filter("message is not null").distinct()
    pattern, message = F.col("message_pattern"), F.col("message")
    entries = entries.select("id", F.col("compiler"), F.col("diag_type").alias("type"), "message_pattern", "ordinal")
    hit = F.rlike(message, F.concat(F.lit("(?i)"), pattern))
    scored = known.join(entries, ["compiler", "type"]).withColumn("matcher", F.when(hit, "regex").otherwise("fuzzy")).withColumn("score", F.when(F.col("matcher") == "regex", regex_match_score(pattern, message)).otherwise(fuzzy_match_score(pattern, message)))
    best = scored.filter("score is not null").groupBy("compiler", "type", "message").agg(F.max_by(F.struct(F.col("id").alias("entry_id"), "matcher", "score"), F.struct("score", -F.col("ordinal"))).alias("best"))
    joined = salted_join(messages, best, ["compiler", "type", "message"], None, "left")
    return joined.select(*messages.columns, F.coalesce("best.entry_id", F.lit("generic.error")).alias("entry_id"), F.coalesce("best.matcher", F.lit("fallback")).alias("matcher"), F.coalesce("best.score", F.lit(0.25)).alias("score"))


def unmatched(matched: DataFrame) -> DataFrame:
    """What the database doesn't know, with how often it was logged."""
    return matched.filter("matcher = 'fallback'").groupBy("compiler", "type", "message").agg(F.count("*").alias("times"))


def explain(matched: DataFrame, entries: DataFrame) -> DataFrame:
    """matched with severity, category, band, title and summary."""
    texts = entries.select(F.col("id").alias("entry_id"), "title", "explanation")
    joined = matched.join(texts, "entry_id", "left")
    title = F.coalesce("title", F.lit("Unknown diagnostic"))
    source = F.coalesce(F.nullif(F.trim("explanation"), F.lit("")), F.nullif(F.trim("message"), F.lit("")), title)
    return joined.select(*matched.columns, title.alias("title"), severity_of(F.col("type")).alias("severity"), category_of(F.col("entry_id")).alias("category"), band(F.col("score")).alias("band"), sentence_case(first_sentence(source)).alias("summary"))


def near_duplicates(a: Column, b: Column) -> Column:
    """Whether two fixes say the same: equal or nearly so once normalized; an empty one equals all."""
    left, right = normalized(a), normalized(b)
    return (left == "") | (right == "") | (left == right) | (token_overlap(a, b) >= 0.8) | (edit_similarity(a, b) >= 0.86)


def distinct_fixes(fixes: Column) -> Column:
    """The sentences of fixes, each kept unless one kept before says the same. What isn't kept rules out nothing."""
    said = F.filter(F.transform(fixes, as_sentence), lambda x: x != "")
    return F.aggregate(said, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: near_duplicates(y, x)), kept).otherwise(F.concat(kept, F.array(x))))


def quick_fixes(explained: DataFrame, entries: DataFrame, keep: list[str], most: int = 5) -> DataFrame:
    """keep, priority, fix_id, fix, action, impact, relevance of the best `most` fixes of each message. keep must name one message."""
    fixes = entries.select(F.col("id").alias("entry_id"), F.posexplode(distinct_fixes(F.col("quick_fixes"))).alias("ordinal", "fix"))
    rows = explained.join(fixes, "entry_id").withColumn("action", action_of(F.col("fix")))
    relevance = quick_fix_relevance(token_overlap(F.col("fix"), F.col("message")), token_overlap(F.col("fix"), category_words(F.col("category"))), F.col("action"), F.col("matcher"), F.col("severity"))
    rows = rows.withColumn("relevance", relevance)
    order = Window.partitionBy(*keep).orderBy(F.col("relevance").desc(), "ordinal")
    ranked = rows.withColumn("priority", F.row_number().over(order)).filter(F.col("priority") <= most)
    return ranked.select(*keep, "priority", F.concat(F.lit("fix-"), "priority").alias("fix_id"), "fix", "action", impact_of(F.col("action"), F.col("severity")).alias("impact"), "relevance")


def message_kind(message: Column) -> Column:
    """A coarse class of a message by its words."""
    text = F.lower(message)
    return F.when(text.contains("undefined reference"), "linker-error").when(text.contains("no matching function"), "type-signature-error").otherwise("general-diagnostic")


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(unique_tokens(a), unique_tokens(b)))


def top_cards(fixes: DataFrame, keep: list[str], most: int = 3) -> DataFrame:
    """The most relevant fixes of all messages of a group (of none for no keep), equal texts once."""
    once = fixes.groupBy(*keep, "fix").agg(F.max("relevance").alias("relevance"), F.min("priority").alias("priority"))
    if not keep:
        return once.orderBy(F.col("relevance").desc(), "priority", "fix").limit(most)
    order = Window.partitionBy(*keep).orderBy(F.col("relevance").desc(), "priority", "fix")
    return once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def headline(title: Column, actions: Column, most: int = 3) -> Column:
    """A title with its first few actions on one line."""
    return F.concat_ws(" - ", title, F.nullif(F.array_join(F.slice(F.coalesce(actions, F.array().cast("array<string>")), 1, most), "; "), F.lit("")))
