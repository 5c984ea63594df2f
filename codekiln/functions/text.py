"""Text expressions: column in, column out, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(x: Column) -> Column:
    """Lower case, anything but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def unique_tokens(x: Column) -> Column:
    """Distinct words of the normalized text in order; an empty array for an empty or null text."""
    return F.array_distinct(F.filter(F.split(F.coalesce(normalized(x), F.lit("")), " "), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words by the larger number of distinct words; 0 if either has none."""
    left, right = unique_tokens(a), unique_tokens(b)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.size(right)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the normalized texts; 1 if both are empty."""
    left, right = F.coalesce(normalized(a), F.lit("")), F.coalesce(normalized(b), F.lit(""))
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(left, right) / longest)


def single_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def sentence_case(x: Column) -> Column:
    line = single_line(x)
    return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30))


def as_sentence(x: Column) -> Column:
    """One line, first letter large, closing mark; empty stays empty."""
    cased = sentence_case(x)
    return F.when((cased == "") | cased.rlike("[.!?]$"), cased).otherwise(F.concat(cased, F.lit(".")))


def first_sentence(x: Column) -> Column:
    return F.element_at(F.split(single_line(x), r"(?<=[.!?])\s+"), 1)


def word_set(x: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def ascii_word(pattern: str) -> str:
    r"""A pattern between word boundaries that, as in JavaScript, know ASCII only; Java's \b doesn't."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def truncated(x: Column, limit: int = 4000, marker: str = "\n...output truncated...") -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit(marker))).otherwise(x)


def html_escaped(x: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x


def rendered(template: Column, params: Column) -> Column:
    """{{name}} replaced by params[name]; names without a value vanish. A value that has {{name}} itself is left as it is.

    The template is cut at its placeholders, so each is looked up once.
    """
    names = F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))
    texts = F.split(template, r"\{\{\w+\}\}")
    values = F.concat(F.transform(names, lambda n: F.coalesce(F.element_at(params, n), F.lit(""))), F.array(F.lit("")))
    return F.array_join(F.zip_with(texts, values, lambda t, v: F.concat(t, v)), "")


def unified_path(x: Column, root: str = "workspace") -> Column:
    r"""Backslashes only, without a leading root folder."""
    back = F.replace(x, F.lit("/"), F.lit("\\"))
    return F.regexp_replace(back, rf"(?i)^(?:.*\\)?{root}\\", "")


def balance(x: Column, opening: str, closing: str) -> Column:
    """Opening signs without closing ones, by number."""
    count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return count(opening) - count(closing)


def angle_escaped(x: Column) -> Column:
    """Signs that a model's vocabulary lacks as words."""
    for sign, word in (("<", "xleftangle"), (">", "xrightangle"), ("{", "xleftbrace"), ("}", "xrightbrace"), ("^", "xcaret"), ("~", "xtilde")):
        x = F.replace(x, F.lit(sign), F.lit(word))
    return x


def largest_fence(x: Column) -> Column:
    """The longest fenced block's body, or the text as it is if there is none."""
    blocks = F.regexp_extract_all(x, F.lit(r"(?s)```[A-Za-z+#]*\r?\n(.*?)```"), F.lit(1))
    best = F.aggregate(blocks, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.regexp_replace(F.when(F.size(blocks) > 0, best).otherwise(x), r"^\s+|\s+$", "")


def severity_of(kind: Column) -> Column:
    return F.when(kind == "error", "HIGH").otherwise("MEDIUM")


def category_of(entry_id: Column) -> Column:
    """Syntax, Type, Template or Linker by a part of the id, else General."""
    out = F.lit("General")
    for name in ("linker", "template", "type", "syntax"):
        out = F.when(F.lower(entry_id).contains(f".{name}."), name.capitalize()).otherwise(out)
    return out


# Words that show what kind of action a quick fix is; a word may be a part of another.
ACTION_WORDS = {
    "edit": "add remove replace change convert declare include pass use move keep provide adjust define link compile cast".split(),
    "check": "check verify confirm inspect ensure review trace".split(),
    "read": "read open consult reference documentation docs".split(),
}
# Words that make a quick fix relevant to a category.
CATEGORY_WORDS = {
    "Syntax": "semicolon brace token expression syntax",
    "Type": "type convert cast operand argument parameter",
    "Template": "template typename instantiation specialization",
    "Linker": "link reference definition object library",
    "General": "",
}


def action_of(fix: Column) -> Column:
    """edit, check or read: the first that has a word in the text; check if none has."""
    text = normalized(fix)
    out = F.lit("check")
    for action in ("read", "check", "edit"):
        out = F.when(text.rlike("|".join(ACTION_WORDS[action])), action).otherwise(out)
    return out


def category_words(category: Column) -> Column:
    out = F.lit("")
    for name, words in CATEGORY_WORDS.items():
        out = F.when(category == name, words).otherwise(out)
    return out


def impact_of(action: Column, severity: Column) -> Column:
    return F.when(action == "edit", F.when(severity.isin("HIGH", "CRITICAL"), "HIGH").otherwise("MEDIUM")).when(action == "check", "MEDIUM").otherwise("LOW")


def feature_label(name: Column, labels: dict[str, str] | None = None) -> Column:
    """A feature's label, or its name in words."""
    words = sentence_case(F.replace(name, F.lit("_"), F.lit(" ")))
    if not labels:
        return words
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), name), words)


def percent_text(p: Column) -> Column:
    return F.coalesce(F.concat(F.floor(p * 100 + 0.5).cast("string"), F.lit("%")), F.lit("N/A"))


def tolerant_json(x: Column, schema: str) -> Column:
    """Null for a text that is no JSON."""
    return F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
