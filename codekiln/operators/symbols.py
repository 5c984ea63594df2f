"""Symbols that source files declare, where they can be seen, and what completes a prefix.

Declarations are read off the tokens of a file, statement by statement; a
statement's first tokens tell what it declares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codekiln.operators.cpp_tokens import Token, behind_angles, closing, tokens_of

# Words that start statements of other kinds than declarations, and words beside a type.
_STATEMENT_WORDS = {"return", "if", "else", "while", "for", "switch", "case", "break", "continue", "delete", "new", "throw", "try", "catch", "do", "goto", "namespace", "using", "public", "private", "protected", "default", "friend", "static_assert", "import", "from", "def"}
_TYPE_WORDS = {"static", "const", "constexpr", "volatile", "mutable", "inline", "virtual", "explicit", "extern", "unsigned", "signed", "long", "short", "register", "thread_local"}
_PLAIN_TYPES = {"unsigned", "signed", "long", "short", "int", "char", "double", "float", "bool", "void", "auto"}
#: Kinds that are seen from any depth.
ALWAYS_SEEN = ["Function", "Class", "Enum", "Interface", "Constant"]
#: What bits/stdc++.h stands for.
STANDARD_HEADERS = ["iostream", "vector", "string", "map", "unordered_map", "set", "unordered_set", "algorithm", "numeric", "stack", "queue", "deque", "list", "array", "fstream", "sstream", "cmath", "cstdlib", "memory", "functional", "utility", "tuple", "bitset", "regex", "climits", "limits", "cassert", "cstring", "thread", "mutex", "chrono"]
SYMBOL_TYPE = "array<struct<name string, kind string, detail string, type string, line int, scope_depth int>>"


def source_lines(files: DataFrame, key: str, code: str) -> DataFrame:
    r"""key, line (from 1), text, scope_depth (braces open behind the line, never below 0). Lines end with \n or \r\n.

    The depth is a running sum less its least value so far, as in a fold that stays at 0.
    """
    lines = files.select(key, F.posexplode(F.split(code, "\r?\n")).alias("k", "text"))
    only = lambda sign: F.length(F.regexp_replace("text", f"[^{sign}]", ""))
    # Within a line, depth may touch 0 between its braces: the least prefix sum of the line counts, too.
    signs = F.split(F.regexp_replace("text", "[^{}]", ""), "")
    least = F.aggregate(signs, F.struct(F.lit(0).alias("s"), F.lit(0).alias("low")), lambda a, c: _stepped(a, c), lambda a: a["low"])
    rows = lines.withColumn("change", only("{") - only("}")).withColumn("dip", least)
    upto = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_now", F.sum("change").over(upto))
    low = F.least(F.lit(0), F.min(F.col("sum_now") - F.col("change") + F.col("dip")).over(upto), F.min("sum_now").over(upto))
    return rows.select(key, (F.col("k") + 1).alias("line"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"), (F.col("sum_now") - low).cast("int").alias("scope_depth"))


def _stepped(a: Column, c: Column) -> Column:
    now = a["s"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    return F.struct(now.alias("s"), F.least(a["low"], now).alias("low"))


def _type_end(tokens: list[Token], at: int) -> int:
    """The place behind the type that starts at `at`: qualifiers, a name with its scopes and arguments, pointers and references. `at` if there is none."""
    k, named = at, False
    while k < len(tokens):
        t = tokens[k]
        if t.text in _TYPE_WORDS or t.text in _PLAIN_TYPES:
            named |= t.text in _PLAIN_TYPES
            k += 1
        elif t.kind == "word" and not named and t.text not in _STATEMENT_WORDS:
            named, k = True, k + 1
            while k < len(tokens) and tokens[k].text in ("::", "<"):
                if tokens[k].text == "<":
                    if (behind := behind_angles(tokens, k)) < 0:
                        return at
                    k = behind
                else:
                    k += 2
        elif named and t.text in ("*", "&", "&&"):
            k += 1
        else:
            break
    return k if named else at


def _source(tokens: list[Token]) -> str:
    """Tokens as one line of source: a blank between words, and behind commas, pointers and arguments."""
    out = ""
    for before, t in zip([None, *tokens], tokens, strict=False):
        glued = before is None or not (t.kind in ("word", "number", "text") and (before.kind in ("word", "number", "text") or before.text in (",", ">", "*", "&", "&&", ")")))
        out += t.text if glued else " " + t.text
    return out


def _parameters(tokens: list[Token], first: int, last: int) -> list[Token] | None:
    """The names of the parameters in tokens[first:last]; None if what stands there is no list of parameters."""
    names, at = [], first
    if _source(tokens[first:last]) in ("", "void"):
        return []
    while at < last:
        if tokens[at].text == "..." or (end := _type_end(tokens, at)) == at:
            return names if tokens[at].text in (".", "...") else None
        if end < last and tokens[end].kind == "word":
            names.append(tokens[end])
            end += 1
        elif end - at == 1 and tokens[at].text not in _PLAIN_TYPES:
            return None  # a single name is an argument rather than a type
        depth = 0
        while end < last and (depth or tokens[end].text != ","):
            depth += (tokens[end].text in "([{<") - (tokens[end].text in ")]}>")
            end += 1
        at = end + 1
    return names


def _declared(tokens: list[Token], ends: list[int], at: int, depth: int) -> Iterator[tuple[str, str, str, str | None, int, int]]:
    """What the statement at tokens[at] declares: (name, kind, detail, type, line, depth)."""
    t = tokens[at]
    if t.text == "template" and at + 1 < len(tokens) and tokens[at + 1].text == "<":
        if (behind := behind_angles(tokens, at + 1)) > 0 and behind < len(tokens):
            yield from _declared(tokens, ends, behind, depth)
        return
    if t.text in ("class", "struct", "enum"):
        k = at + 1 + (t.text == "enum" and at + 1 < len(tokens) and tokens[at + 1].text in ("class", "struct"))
        if k + 1 < len(tokens) and tokens[k].kind == "word" and (tokens[k + 1].text in ("{", ":", ";") or tokens[k + 1].text == "final"):
            yield tokens[k].text, "Enum" if t.text == "enum" else "Class", f"{t.text} {tokens[k].text}", None, t.line, depth
            return
        at = k if t.text == "struct" else at
    if t.text in ("typedef", "using"):
        end = next((k for k in range(at, min(len(tokens), at + 300)) if tokens[k].text in (";", "{") and not (tokens[k].text == "{" and t.text == "typedef")), -1)
        name = tokens[end - 1] if t.text == "typedef" else tokens[at + 1] if at + 2 < len(tokens) and tokens[at + 2].text == "=" else None
        if end > at + 1 and name is not None and name.kind == "word":
            yield name.text, "Interface", _source(tokens[at:end]), None, t.line, depth
        return
    if t.kind != "word" or t.text in _STATEMENT_WORDS:
        return
    end = _type_end(tokens, at)
    if end == at or end + 1 >= len(tokens) or tokens[end].kind != "word" or tokens[end].text in _STATEMENT_WORDS:
        return
    kept = [x for x in tokens[at:end] if x.text not in ("static", "inline", "virtual", "explicit", "constexpr", "extern", "mutable")]
    kind, name, behind = _source(kept), tokens[end], tokens[end + 1].text
    if behind == "(" and ends[end + 1] >= 0:
        last = ends[end + 1]
        after = tokens[last + 1].text if last + 1 < len(tokens) else ";"
        given = _parameters(tokens, end + 2, last)
        if given is not None and (after in ("{", ";", ":", "const", "noexcept", "override", "final", "->", "=", "try") or last + 1 == len(tokens)):
            yield name.text, "Function", f"{kind} {name.text}({_source(tokens[end + 2 : last])})", None, name.line, depth
            for p in given:
                yield p.text, "Variable", f"parameter of {name.text}", None, p.line, depth + 1
            return
    if behind in ("=", ";", "[", "{", "(", ","):
        yield name.text, "Variable", f"{kind} {name.text}", kind, name.line, depth


def symbols_of(code: str) -> list[tuple[str, str, str, str | None, int, int]]:
    """(name, kind, detail, type, line, scope depth) of what code declares, in order.

    Kinds are Function, Class, Enum, Interface (other names of types), Constant
    (macros) and Variable. Each name comes once for its kind, where it is first;
    variables once for each depth, and only those of two characters or more.
    """
    tokens, out, seen = tokens_of(code), [], set()
    ends, depth, begins = closing(tokens), 0, True
    for k, t in enumerate(tokens):
        found = []
        if t.kind == "directive":
            words = t.text[1:].split(None, 2)
            if len(words) > 1 and words[0] == "define":
                found = [(words[1].split("(")[0], "Constant", " ".join(t.text.split()), None, t.line, 0)]
        elif begins:
            # A depth counts the braces that are open at the end of the statement's first line.
            here = k
            level = depth
            while here < len(tokens) and tokens[here].line == t.line:
                level = max(0, level + (tokens[here].text == "{") - (tokens[here].text == "}"))
                here += 1
            found = list(_declared(tokens, ends, k, level))
        for own in found:
            once = own[:2] if own[1] != "Variable" else (*own[:2], own[5])
            if once not in seen and (own[1] != "Variable" or len(own[0]) > 1):
                seen.add(once)
                out.append(own)
        depth = max(0, depth + (t.text == "{") - (t.text == "}"))
        begins = t.kind == "directive" or t.text in (";", "{", "}") or (t.text == "(" and k > 0 and tokens[k - 1].text == "for") or (t.text == ":" and k > 0 and tokens[k - 1].text in ("public", "private", "protected"))
    return out


def symbols(files: DataFrame, key: str, code: str) -> DataFrame:
    """key, name, kind, detail, type, line, scope_depth of what files declare; see symbols_of. Null code declares nothing."""

    @F.pandas_udf(SYMBOL_TYPE)
    def read(codes: pd.Series) -> pd.Series:
        names = ("name", "kind", "detail", "type", "line", "scope_depth")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in symbols_of(c)] if c else [] for c in codes], dtype=object)

    return files.select(key, F.inline(read.asNondeterministic()(F.col(code))))


def visible_symbols(found: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """cursors (key, line, scope_depth) with the symbols that can be seen there."""
    at = cursors.select(key, F.col("line").alias("cursor_line"), F.col("scope_depth").alias("cursor_depth"))
    seen = (F.col("line") <= F.col("cursor_line")) & ((F.col("scope_depth") == 0) | F.col("kind").isin(ALWAYS_SEEN) | (F.col("scope_depth") <= F.col("cursor_depth")))
    return found.join(at, key).filter(seen).select(key, "cursor_line", "name", "kind", "line")


def included_headers(files: DataFrame, key: str, code: str, everything: list[str] | None = None) -> DataFrame:
    """key, header of every include, in angle brackets or quotes: the last part of its path without .h.

    bits/stdc++.h stands for all of `everything`, or for nothing where that is left out.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(code), F.lit('#include\\s*[<"]([^>"]+)[>"]'), F.lit(1)))
    whole = F.array(*[F.lit(h) for h in everything or []]).cast("array<string>")
    names = F.flatten(F.transform(found, lambda h: F.when(h == "bits/stdc++.h", whole).otherwise(F.array(F.regexp_replace(F.element_at(F.split(h, "/"), -1), "\\.h$", "")))))
    return files.select(key, F.explode(F.array_distinct(names)).alias("header"))


def ranked_completions(offers: DataFrame, prefix: Column) -> DataFrame:
    """offers (label, source) whose label starts with the prefix, letter case aside; each label once, user's before members before library's. sort_text gives the order to show them in; nothing is sorted over all rows."""
    weight = F.when(F.col("source") == "user", "a").when(F.col("source") == "member", "b").otherwise("c")
    fitting = offers.filter(F.lower("label").startswith(F.lower(prefix))).withColumn("sort_text", F.concat(weight, "label"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("sort_text", "source"))
    return fitting.withColumn("k", first).filter("k = 1").drop("k")


def member_offers(uses: DataFrame, declared: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Members that complete a variable: uses (key, name), declared (key, name, type), members (type, member).

    A type's std:: and its arguments don't count, so std::vector<int> has vector's members.
    """
    base = F.regexp_extract("type", r"^(?:const\s+)?(?:std::)?(\w+)", 1)
    types = declared.select(key, "name", base.alias("base")).distinct()
    return uses.join(types, [key, "name"]).join(members.withColumnRenamed("type", "base"), "base").select(key, "name", F.col("member").alias("label"), F.lit("member").alias("source"))
