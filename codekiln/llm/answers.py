"""What answers that say nothing look like; shared by the operators on prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders that stand for an answer, in lower case.
PLACEHOLDERS = ["null", "none", "nil", "undefined", "nan", "n/a", "n.a.", "na", "tbd", "tba", "todo", "fixme", "xxx", "pass", "wip", "empty", "missing", "placeholder", "no answer", "no response", "not available", "your code here", "insert code here", "code here"]


def is_blank(text: Column) -> Column:
    """Null, empty, white space or invisible characters only."""
    return F.coalesce(~text.rlike(r"[^\s\p{Z}\p{C}ㅤᅟᅠ⠀️͏]"), F.lit(True))


def is_empty_answer(text: Column) -> Column:
    """Blank, comments without content, signs without a letter or digit, or a mere placeholder, as a comment or bracketed too.

    Only short texts can be placeholders; a text with a letter or digit outside of
    one isn't empty.
    """
    said = F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{C}/*#<>\[\](){}'\"`.;:!\-_=~…|]+", " ")))
    signless = F.coalesce(~text.rlike(r"[\p{L}\p{N}]"), F.lit(True))
    words = [p.replace("/", " ").replace(".", " ").strip() for p in PLACEHOLDERS]
    return signless | (F.length(text) < 200) & said.isin(sorted(set(words)))
