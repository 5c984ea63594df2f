"""Previews of rewrites: const references, range loops, formatting, and the difference as a patch.

Rewrites work on tokens: a piece of source is found by what its tokens are, and
only the characters of those that change are replaced.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codekiln.operators.cpp_tokens import Token, behind_angles, closing, tokens_of

# Containers that are costly to copy, and types of loop counters.
CONTAINERS = {"vector", "string", "map", "set", "unordered_map", "unordered_set", "list", "deque", "array", "queue", "stack", "priority_queue"}
COUNTER_TYPES = {"int", "size_t"}
#: Words in front of brackets that hold no parameters.
_NO_FUNCTIONS = {"if", "while", "for", "switch", "return", "catch", "sizeof"}


def _texts(tokens: list[Token], at: int, n: int) -> list[str]:
    return [t.text for t in tokens[at : at + n]]


def by_const_reference(code: str) -> str | None:
    """The first container parameter by value as a const reference; None if there is none.

    A parameter stands in the brackets behind a function's name, after the opening
    bracket or a comma. std:: may be left out where the file has `using namespace std`.
    """
    tokens = tokens_of(code)
    ends = closing(tokens)
    plain = any(_texts(tokens, k, 4) == ["using", "namespace", "std", ";"] for k in range(len(tokens)))
    limit = -1  # the end of the parameters at hand
    for k, t in enumerate(tokens):
        if t.text == "(" and k and tokens[k - 1].kind == "word" and tokens[k - 1].text not in _NO_FUNCTIONS:
            limit = max(limit, ends[k])
        if t.text not in ("(", ",") or not k < limit:
            continue
        first = at = k + 1
        if _texts(tokens, at, 2) == ["std", "::"]:
            at += 2
        elif not plain:
            continue
        if at >= limit or tokens[at].text not in CONTAINERS:
            continue
        at += 1
        if tokens[at].text == "<":
            at = behind_angles(tokens, at)
        if 0 < at < limit and tokens[at].kind == "word" and tokens[at + 1].text in (",", ")"):
            kept = code[tokens[first].start : tokens[at - 1].end]
            return f"{code[: tokens[first].start]}const {kept}& {code[tokens[at].start :]}"
    return None


def _counted_loop(tokens: list[Token], at: int, end: int) -> tuple[str, str] | None:
    """Counter and container of the loop head between the brackets at `at` and `end`, if it counts a container's elements from 0."""
    parts: list[list[str]] = [[]]
    for t in tokens[at + 1 : end]:
        if t.text == ";":
            parts.append([])
        else:
            parts[-1].append(t.text)
    if len(parts) != 3:
        return None
    start, until, step = parts
    start = start[2:] if start[:2] == ["std", "::"] else start
    if len(start) != 4 or start[0] not in COUNTER_TYPES or start[2:] != ["=", "0"]:
        return None
    counter = start[1]
    if len(until) != 7 or until[:2] != [counter, "<"] or until[3:] != [".", "size", "(", ")"] or sorted(step) != sorted(["++", counter]):
        return None
    return counter, until[2]


def as_range_loop(code: str) -> str | None:
    """The first index loop over its container's elements, if the index does nothing else; else None.

    The loop has a block; elements may be changed in it only if no reference would
    be const, so loops that assign to an element stay as they are.
    """
    tokens = tokens_of(code)
    ends = closing(tokens)
    for k, t in enumerate(tokens):
        if t.text != "for" or _texts(tokens, k + 1, 1) != ["("] or (shut := ends[k + 1]) < 0:
            continue
        if (head := _counted_loop(tokens, k + 1, shut)) is None:
            continue
        if _texts(tokens, shut + 1, 1) != ["{"] or (last := ends[shut + 1]) < 0:
            continue
        counter, container = head
        uses = [j for j in range(shut + 2, last) if tokens[j].text == counter]
        elements = [j for j in uses if _texts(tokens, j - 2, 4) == [container, "[", counter, "]"] and tokens[j - 3].text not in (".", "->", "::")]
        written = any(_texts(tokens, j + 2, 1)[0] in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--") for j in elements)
        if not uses or uses != elements or written:
            return None
        out, done = [code[: t.start], f"for (const auto& item : {container})"], tokens[shut].end
        for j in elements:
            out += [code[done : tokens[j - 2].start], "item"]
            done = tokens[j + 1].end
        return "".join(out) + code[done:]
    return None


def patch(before: str, after: str, name: str = "preview") -> str:
    """What differs, as a unified patch without context; empty if nothing does."""
    path = name.replace("\\", "/")
    lines = difflib.unified_diff(before.splitlines(), after.splitlines(), f"a/{path}", f"b/{path}", lineterm="", n=0)
    return "\n".join(lines)


def formatted(code: str, indent: str = "    ") -> str:
    """One statement a line, indent by braces, no more than one blank line in a row; comments and strings stay as they are."""
    lines: list[str] = []
    depth, brackets, held = 0, 0, ""

    def put() -> None:
        nonlocal held
        if held.strip():
            lines.append(indent * (depth - (held.strip()[0] == "}")) + held.strip())
        held = ""

    blank = 0
    for m in re.finditer(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|^[ \t]*#[^\n]*|\n|.', code, re.S | re.M):
        t = m[0]
        if t == "\n":
            if held.strip():
                if brackets == 0 and not held.strip().endswith((",", "(", "=", "+", "-", "*", "/", "&&", "||", "<<")):
                    put()
                else:
                    held += " "
                blank = 0
            else:
                blank += 1
                if blank == 2 and lines and lines[-1]:
                    lines.append("")
            continue
        blank = 0 if t.strip() else blank
        if t.startswith("//") or t.lstrip().startswith("#"):
            if t.startswith("//") and held.strip():
                held += t
            else:
                put()
                held = t
            put()
        elif t == ";" and brackets == 0:
            held += t
            put()
        elif t == "{" and brackets == 0 and not re.search(r"[=,]\s*$", held):
            held = held.rstrip() + " {" if held.strip() else "{"
            put()
            depth += 1
        elif t == "}" and brackets == 0 and "{" not in held:
            put()
            held = "}"
            put()
            depth = max(0, depth - 1)
        else:
            brackets = max(0, brackets + (t in "([") - (t in ")]"))
            held += t
    put()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines) + "\n" if lines else ""


def previews(files: DataFrame, key: str, code: str) -> DataFrame:
    """key, rewrite, patch of each rewrite that applies to a file. Null code has none."""

    @F.pandas_udf("array<struct<rewrite string, patch string>>")
    def make(codes: pd.Series) -> pd.Series:
        out = []
        for c in codes:
            made = [(n, f(c)) for n, f in (("const-reference", by_const_reference), ("range-loop", as_range_loop))] if c is not None else []
            out.append([{"rewrite": n, "patch": patch(c, new)} for n, new in made if new is not None])
        return pd.Series(out)

    return files.select(key, F.inline(make(F.col(code))))


def format_files(files: DataFrame, key: str, code: str) -> DataFrame:
    """key, code, formatted."""

    @F.pandas_udf("string")
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: None if c is None else formatted(c))

    return files.select(key, code, run(F.col(code)).alias("formatted"))
