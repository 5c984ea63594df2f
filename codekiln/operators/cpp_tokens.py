"""Tokens of C++-like source, and walks over them that other operators share."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<gap>[ \t\r\n\f\v]+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<directive>(?<![^\n])[ \t]*\#(?:[^\n\\]|\\.)*)
    |(?P<text>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
    |(?P<word>[^\W\d]\w*)
    |(?P<number>\d[\w.']*)
    |(?P<sign>::|->|\+\+|--|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|.)""",
    re.S | re.X,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True, slots=True)
class Token:
    """kind: word, number, text, sign or directive. The token is code[start:end], on `line` (from 1)."""

    kind: str
    text: str
    start: int
    end: int
    line: int


def tokens_of(code: str) -> list[Token]:
    """The tokens of code; comments and white space are none. Whatever it is given, every other character is in one."""
    out, line = [], 1
    for m in _TOKEN.finditer(code):
        kind, text = m.lastgroup, m[0]
        if kind != "gap":
            lead = len(text) - len(text.lstrip()) if kind == "directive" else 0
            out.append(Token(kind, text[lead:], m.start() + lead, m.end(), line))
        line += text.count("\n")
    return out


def closing(tokens: list[Token]) -> list[int]:
    """For each token the place of what closes it, if it opens a round, square or curly bracket that is closed; else -1."""
    out, opened = [-1] * len(tokens), []
    for k, t in enumerate(tokens):
        if t.text in _PAIRS and t.kind == "sign":
            opened.append(k)
        elif t.text in ")]}" and t.kind == "sign" and opened and _PAIRS[tokens[opened[-1]].text] == t.text:
            out[opened.pop()] = k
    return out


def behind_angles(tokens: list[Token], at: int) -> int:
    """The place behind the template arguments that open at `at`, or -1 if they aren't closed within the statement."""
    depth = 0
    for k in range(at, min(len(tokens), at + 200)):
        sign = tokens[k].text
        if sign == "<":
            depth += 1
        elif sign == ">":
            depth -= 1
            if depth == 0:
                return k + 1
        elif sign in (";", "{", "}", "&&", "||"):
            return -1
    return -1
