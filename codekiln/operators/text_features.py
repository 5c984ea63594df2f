"""Features of source text by regular expressions, without a parser, and the risk label made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codekiln.functions.score import risk_label, risk_score
from codekiln.functions.text import ascii_word

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# What is counted, in the order of the feature vector's groups.
PATTERNS = {
    "for_all": rf"{_B}for\s*\(",
    "loops_range_for": rf"{_B}for\s*\(.*?:",
    "loops_while": rf"{_B}while\s*\(",
    "loops_do_while": rf"{_B}do\s*\{{",
    "pointers_declarations": rf"{_B}\w+\s*\*\s*\w+",
    "pointers_dereferences": r"\*\s*\w+|\w+\s*->",
    "pointers_address_of": r"&\s*\w+",
    "stl_container_refs": ascii_word("vector|list|deque|map|set|unordered_map|unordered_set|multimap|multiset|queue|stack|priority_queue"),
    "stl_algorithm_calls": rf"{_B}(?:sort|find|count|accumulate|transform|copy|remove|replace|reverse|for_each|lower_bound|upper_bound|binary_search|merge|unique)\s*\(",
    "stl_iterator_usage": ascii_word("begin|end|rbegin|rend|cbegin|cend|iterator|const_iterator"),
    "alloc_heap_new": ascii_word("new"),
    "alloc_heap_delete": ascii_word("delete"),
    "alloc_malloc_family": ascii_word("malloc|calloc|realloc"),
    "alloc_free_calls": rf"{_B}free\s*\(",
    "alloc_stack_arrays": rf"{_B}\w+\s+\w+\s*\[",
    "semantic_high_severity_count": rf"{_B}null{_E}|->next->next|delete\s+\w+;\s*\*\w+",
    "void_pointers": rf"{_B}void\s*\*",
}
#: Letters and digits of other scripts; they are parts of words like those of ASCII, so counts take each for an x.
OTHER_LETTERS = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"
NOT_FUNCTIONS = ["if", "while", "for", "switch", "catch", "else"]
FUNCTION_HEAD = rf"{_B}([a-zA-Z_]\w*)\s*\([^)]*\)\s*\{{"
LINE_WITH_HEAD = rf"{_B}\w+\s*\([^)]*\)\s*\{{"
FEATURE_COLUMNS = (
    "loops_total loops_for loops_while loops_do_while loops_range_for nesting_max_depth recursion_count function_count pointers_declarations pointers_dereferences pointers_address_of pointers_total "
    "stl_container_refs stl_algorithm_calls stl_iterator_usage stl_total alloc_heap_new alloc_heap_delete alloc_malloc_family alloc_free_calls alloc_stack_arrays alloc_total "
    "semantic_issue_count semantic_high_severity_count code_smell_count code_smell_high_severity_count complexity_time_rank complexity_space_rank"
).split()


def brace_depth(code: Column) -> Column:
    """Most braces open at once; a closing brace too many counts as none."""
    signs = F.split(F.regexp_replace(code, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c == "{", s["open"] + 1).when(c == "}", F.greatest(F.lit(0), s["open"] - 1)).otherwise(s["open"])
        return F.struct(now.alias("open"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, zero, step, lambda s: s["most"])


def function_names(code: Column) -> Column:
    """Distinct names in front of brackets and a brace, without the words of the language."""
    return F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit(FUNCTION_HEAD), F.lit(1))), lambda n: ~n.isin(NOT_FUNCTIONS))


def recurring_names(code: Column, names: Column) -> Column:
    """How many of the names stand in front of a bracket twice or more. A function that is called at all counts."""
    return F.size(F.filter(names, lambda n: F.regexp_count(code, F.concat(F.lit(_B), n, F.lit(r"\s*\("))) >= 2))


def long_functions(code: Column, most: int = 40) -> Column:
    """Functions whose last brace closes more than `most` lines below their head. A new head takes the place of one that is still open."""
    opened = lambda s: F.length(F.regexp_replace(s, "[^{]", "")) - F.length(F.regexp_replace(s, "[^}]", ""))
    lines = F.transform(F.split(code, "\n"), lambda s: F.struct(s.rlike(LINE_WITH_HEAD).alias("head"), opened(s).cast("int").alias("change")))
    # below: lines since the head, -1 outside of functions.
    zero = F.struct(F.lit(-1).alias("below"), F.lit(0).alias("open"), F.lit(0).alias("found"))

    def behind(a: Column, line: Column) -> Column:
        inside = F.when(line["head"], 0).when(a["below"] >= 0, a["below"] + 1).otherwise(-1)
        still = F.when(line["head"], line["change"]).otherwise(a["open"] + line["change"])
        closed = (inside > 0) & (still <= 0)
        return F.struct(F.when(closed, -1).otherwise(inside).alias("below"), still.alias("open"), (a["found"] + (closed & (inside > most)).cast("int")).alias("found"))

    return F.aggregate(lines, zero, behind, lambda a: a["found"])


def text_features(files: DataFrame, key: str, code: str) -> DataFrame:
    """key and the 28 columns of the feature vector, doubles in their order. Null code counts as empty."""
    rows = files.select(F.col(key), F.coalesce(F.col(code), F.lit("")).alias("code"))
    rows = rows.withColumn("plain", F.regexp_replace("code", OTHER_LETTERS, "x"))
    rows = rows.withColumns({n: F.regexp_count("plain", F.lit(p)) for n, p in PATTERNS.items()} | {"names": function_names(F.col("code")), "nesting_max_depth": brace_depth(F.col("code")), "code_smell_high_severity_count": long_functions(F.col("code"))})
    rows = rows.withColumns({"function_count": F.size("names"), "recursion_count": recurring_names(F.col("code"), F.col("names"))})
    c = F.col
    rows = rows.withColumns(
        {
            "loops_total": c("for_all") + c("loops_while") + c("loops_do_while"),
            "loops_for": F.greatest(F.lit(0), c("for_all") - c("loops_range_for")),
            "pointers_total": c("pointers_declarations") + c("pointers_dereferences") + c("pointers_address_of"),
            "stl_total": c("stl_container_refs") + c("stl_algorithm_calls") + c("stl_iterator_usage"),
            "alloc_total": c("alloc_heap_new") + c("alloc_heap_delete") + c("alloc_malloc_family") + c("alloc_free_calls") + c("alloc_stack_arrays"),
            "semantic_issue_count": c("semantic_high_severity_count") + c("void_pointers"),
            "code_smell_count": c("code_smell_high_severity_count") + F.greatest(F.lit(0), c("function_count") - 5),
        }
    )
    depth, loops = c("nesting_max_depth"), c("loops_total")
    rows = rows.withColumn("complexity_time_rank", F.when((depth >= 5) | (loops >= 6), 6).when((depth >= 3) | (loops >= 3), 4).when(loops >= 1, 2).otherwise(1))
    rows = rows.withColumn("complexity_space_rank", F.least(F.lit(6), F.greatest(F.lit(1), F.floor(depth / 2) + c("recursion_count"))))
    return rows.select(key, *[c(n).cast("double").alias(n) for n in FEATURE_COLUMNS])


def with_risk(features: DataFrame) -> DataFrame:
    score = risk_score(F.col)
    return features.withColumns({"risk_score": score, "risk_label": risk_label(score)})
