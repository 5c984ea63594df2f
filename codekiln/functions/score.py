"""Scores, bands and ranks as column expressions, evaluated in the order they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codekiln.functions.text import edit_similarity, token_overlap


def rounded(x: Column, digits: int = 3) -> Column:
    """Half up towards infinity in binary, unlike round()."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def band(confidence: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    """high, medium or low; models use .75 and .5."""
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def regex_match_score(pattern: Column, message: Column) -> Column:
    """Of a message that the pattern matches: at most .99, more for long patterns whose words the message has."""
    specific = F.least(F.lit(0.2), F.length(pattern) / 180)
    return F.least(F.lit(0.99), 0.72 + specific + token_overlap(pattern, message) * 0.12 + edit_similarity(pattern, message) * 0.08)


def fuzzy_match_score(pattern: Column, message: Column, least: float = 0.5) -> Column:
    """Of a message that the pattern doesn't match: at most .8; null below the threshold."""
    likeness = token_overlap(pattern, message) * 0.68 + edit_similarity(pattern, message) * 0.32
    return F.when(likeness >= least, F.least(F.lit(0.8), 0.42 + likeness * 0.5))


def quick_fix_relevance(message_overlap: Column, category_overlap: Column, action: Column, matcher: Column, severity: Column) -> Column:
    action_part = F.when(action == "edit", 0.16).when(action == "check", 0.1).otherwise(0.04)
    matcher_part = F.when(matcher == "regex", 0.08).when(matcher == "fuzzy", 0.05).otherwise(0.0)
    severity_part = F.when(severity.isin("HIGH", "CRITICAL"), 0.08).otherwise(0.04)
    return F.least(F.lit(0.99), 0.38 + message_overlap * 0.3 + category_overlap * 0.2 + action_part + matcher_part + severity_part)


def stl_signal(containers: Column, algorithms: Column, iterators: Column, total: Column) -> Column:
    share = lambda x, most: F.least(F.lit(1.0), x / most)
    return share(total, 8) * 0.5 + share(containers, 4) * 0.2 + share(algorithms, 3) * 0.2 + share(iterators, 3) * 0.1


def stl_boost(weight: Column, signal: Column) -> Column:
    return F.least(F.lit(0.15), F.coalesce(weight, F.lit(0.08)) * signal)


def calibrated(preliminary: Column, strength: Column, boost: Column, pressure: Column, density: Column, preview: Column, most: Column) -> Column:
    raw = clamp(preliminary, 0, 1) * 0.8 + strength * 0.15 + clamp(boost / 0.15, 0, 1) * 0.03 + pressure * 0.01 + density * 0.005 + preview * 0.005
    return clamp(F.least(most, raw), 0, 1)


# Ranks of growth.
BIG_O_RANKS = {"O(1)": 1, "O(log n)": 2, "O(n)": 3, "O(n log n)": 4, "O(n^2)": 5, "O(n^3)": 6, "O(2^n)": 7, "O(n!)": 8}


def big_o_rank(x: Column) -> Column:
    """0 for anything that isn't in the table, such as powers above 3."""
    out = F.lit(0)
    for name, rank in BIG_O_RANKS.items():
        out = F.when(F.trim(x) == name, rank).otherwise(out)
    return out


def big_o_rank_extended(x: Column) -> Column:
    """As big_o_rank, with powers above 3 between O(n^3) and O(2^n)."""
    power = F.try_to_number(F.regexp_extract(x, r"^\s*O\(n\^(\d{1,3})\)\s*$", 1), F.lit("999")).cast("int")
    return F.when(power > 3, 6 + F.least(power, F.lit(100)) / 101.0).otherwise(big_o_rank(x).cast("double"))


def time_complexity(loops: Column, depth: Column, recursion: Column, algorithms: Column, loops_exceed: Column, nesting_exceeds: Column) -> tuple[Column, Column]:
    """Growth and confidence, decided in order: loops, library algorithms, recursion, then doubts."""
    looped = F.when(depth <= 1, "O(n)").when(depth == 2, "O(n^2)").otherwise(F.concat(F.lit("O(n^"), depth.cast("string"), F.lit(")")))
    growth = F.when(recursion > 0, F.when((depth >= 1) | (loops > 0), "O(n^2)").otherwise("O(n)")).when(loops > 0, looped).when(algorithms > 0, "O(n log n)").otherwise("O(1)")
    sure = F.when(recursion > 0, "low").when((loops > 0) & (depth <= 2), "high").otherwise("medium")
    return growth, F.when(loops_exceed | nesting_exceeds, F.when(sure == "high", "medium").otherwise("low")).otherwise(sure)


def space_complexity(recursion: Column, allocations: Column, threshold: Column) -> tuple[Column, Column]:
    growth = F.when((recursion > 0) | (allocations > 0), "O(n)").otherwise("O(1)")
    sure = F.when(allocations > 0, F.when(allocations > threshold, "medium").otherwise("low")).when(recursion > 0, "low").otherwise("medium")
    return growth, sure


def risk_score(c) -> Column:
    """c gives a feature's column by name."""
    return (
        c("loops_total") * 1.4
        + c("nesting_max_depth") * 2.2
        + c("recursion_count") * 3.0
        + c("alloc_total") * 1.8
        + c("complexity_time_rank") * 2.5
        + c("semantic_high_severity_count") * 2.0
        + c("code_smell_high_severity_count") * 1.5
    )


def risk_label(score: Column) -> Column:
    return F.when(score >= 28, "risk_high").when(score >= 16, "risk_medium").otherwise("risk_low")


def compared(left: Column, operator: Column, right: Column) -> Column:
    """Whether the comparison that the data names holds; null if left is null."""
    return (
        F.when(operator == ">=", left >= right)
        .when(operator == ">", left > right)
        .when(operator == "<=", left <= right)
        .when(operator == "<", left < right)
        .otherwise(left == right)
    )
