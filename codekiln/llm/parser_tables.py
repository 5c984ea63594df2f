"""Tables of a bottom-up parser from a bundled grammar, and the machine that runs them.

A grammar is a text: lines "%token NAME c" give a token the character by which it
appears in a token stream; rules are "name: symbols | symbols | ;". A token stream
is a string of such characters with line ends between them.

The machine remembers what a line does to its stack: which states it takes off and
which it puts on. Programs are made of few kinds of lines, so most lines are one
lookup, and the result is the same as token by token.
"""

from __future__ import annotations

import os
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

END = "\0"


@dataclass(frozen=True)
class Tables:
    """shifts and reductions: by state and token; gotos: by state and nonterminal; rules: (nonterminal, length).
    conflicts: what was settled by shifting, or by the earlier rule."""

    shifts: list[dict[str, int]]
    reductions: list[dict[str, int]]
    gotos: list[dict[str, int]]
    rules: list[tuple[str, int]]
    conflicts: list[str]


def read_grammar(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], dict[str, str]]:
    """The rules in order, tokens already as their characters, and the tokens' names."""
    tokens, rules, body = {}, [], []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if words[:1] == ["%token"]:
            tokens[words[1]] = words[2]
        else:
            body += words
    name = ""
    for k, word in enumerate(body):
        if word.endswith(":") and len(word) > 1:
            name, part = word[:-1], []
        elif word in ("|", ";") and name:
            rules.append((name, tuple(part)))
            part = []
            if word == ";":
                name = ""
        else:
            part.append(tokens.get(word, word))
    names = {n for n, _ in rules}
    unknown = {s for _, right in rules for s in right if s not in names and s not in tokens.values()}
    if unknown:
        raise ValueError(f"neither a token nor a rule: {sorted(unknown)}")
    return rules, {c: n for n, c in tokens.items()}


def build_tables(text: str) -> Tables:
    """SLR(1) tables of the grammar, whose first rule is what a whole text must be."""
    rules, _ = read_grammar(text)
    rules = [("%start", (rules[0][0],)), *rules]
    by_name: dict[str, list[int]] = defaultdict(list)
    for k, (name, _) in enumerate(rules):
        by_name[name].append(k)

    empty: set[str] = set()
    first: dict[str, set[str]] = defaultdict(set)
    follow: dict[str, set[str]] = defaultdict(set)
    follow["%start"].add(END)

    def firsts(symbols: tuple[str, ...]) -> tuple[set[str], bool]:
        out: set[str] = set()
        for s in symbols:
            out |= first[s] if s in by_name else {s}
            if s not in empty:
                return out, False
        return out, True

    changed = True
    while changed:
        changed = False
        for name, right in rules:
            found, none = firsts(right)
            if not found <= first[name] or (none and name not in empty):
                first[name] |= found
                empty.update([name] * none)
                changed = True
    changed = True
    while changed:
        changed = False
        for name, right in rules:
            for k, s in enumerate(right):
                if s in by_name:
                    found, none = firsts(right[k + 1 :])
                    found = found | (follow[name] if none else set())
                    if not found <= follow[s]:
                        follow[s] |= found
                        changed = True

    def closure(items: frozenset) -> list[tuple[int, int]]:
        out, todo, seen = [], sorted(items), set(items)
        while todo:
            rule, at = item = todo.pop(0)
            out.append(item)
            right = rules[rule][1]
            if at < len(right):
                for k in by_name.get(right[at], []):
                    if (k, 0) not in seen:
                        seen.add((k, 0))
                        todo.append((k, 0))
        return out

    start = frozenset([(0, 0)])
    numbers, sets = {start: 0}, [start]
    tables = Tables([], [], [], [(name, len(right)) for name, right in rules], [])
    k = 0
    while k < len(sets):
        moves: dict[str, set] = defaultdict(set)
        reduce: dict[str, int] = {}
        for rule, at in closure(sets[k]):
            right = rules[rule][1]
            if at < len(right):
                moves[right[at]].add((rule, at + 1))
                continue
            for token in follow[rules[rule][0]]:
                if token in reduce and reduce[token] != rule:
                    tables.conflicts.append(f"state {k}, {token!r}: rules {rules[min(rule, reduce[token])]} and {rules[max(rule, reduce[token])]}")
                reduce[token] = min(rule, reduce.get(token, rule))
        shift, goto = {}, {}
        for symbol, items in moves.items():
            target = frozenset(items)
            if target not in numbers:
                numbers[target] = len(sets)
                sets.append(target)
            (goto if symbol in by_name else shift)[symbol] = numbers[target]
        for token in set(shift) & set(reduce):
            tables.conflicts.append(f"state {k}, {token!r}: shift before rule {rules[reduce.pop(token)]}")
        tables.shifts.append(shift)
        tables.reductions.append(reduce)
        tables.gotos.append(goto)
        k += 1
    return tables


@lru_cache
def bundled_tables(language: str) -> Tables:
    with open(os.path.join(os.path.dirname(__file__), "grammars", f"{language}.grammar"), encoding="utf-8") as f:
        return build_tables(f.read())


class Machine:
    """Parses token streams with one language's tables.

    `semicolon` is the token that may be put in where a line has ended, before
    `closing`, and at the end, if the next token can't follow; None for languages
    without that rule.
    """

    LINES_KEPT = 300_000

    def __init__(self, tables: Tables, semicolon: str | None = None, closing: str = "") -> None:
        self.tables, self.semicolon, self.closing = tables, semicolon, closing
        self.lines: dict[tuple[int, str], list[tuple[tuple[int, ...], tuple[int, ...]]]] = {}
        self.kept = 0

    def _take(self, stack: list[int], token: str) -> int:
        """Reduces, then shifts token. The least height that the stack had, or -1 if token can't follow."""
        t, low = self.tables, len(stack)
        while True:
            state = stack[-1]
            if (to := t.shifts[state].get(token)) is not None:
                stack.append(to)
                return low
            rule = t.reductions[state].get(token)
            if rule is None:
                return -1
            if rule == 0:
                return low
            name, length = t.rules[rule]
            if length:
                del stack[-length:]
            low = min(low, len(stack) - 1)  # what is put on depends on the state below, too
            stack.append(t.gotos[stack[-1]][name])

    def _line(self, stack: list[int], line: str) -> int:
        """The least height the stack had over the line; -1 - k if its token k can't follow."""
        low = len(stack)
        for k, token in enumerate(line):
            before = stack[:]
            at = self._take(stack, token)
            if at < 0 and self.semicolon and (k == 0 or token in self.closing):
                stack[:] = before
                at = self._take(stack, self.semicolon)
                if at >= 0:
                    low = min(low, at)
                    at = self._take(stack, token)
            if at < 0:
                return -1 - k
            low = min(low, at)
        return low

    def parse(self, stream: str) -> tuple[int, int] | None:
        """None for a whole text of the language; else the line and the place in it, from 0, of the first token that can't follow, or of the end."""
        stack = [0]
        n, line = 0, ""
        for n, line in enumerate(stream.split("\n")):
            if not line:
                continue
            known = self.lines.get((stack[-1], line))
            if known is not None:
                for taken, put in known:
                    if len(taken) <= len(stack) and (not taken or tuple(stack[-len(taken) :]) == taken):
                        if taken:
                            del stack[-len(taken) :]
                        stack.extend(put)
                        break
                else:
                    known = None
            if known is None:
                before = stack[:]
                low = self._line(stack, line)
                if low < 0:
                    return n, -1 - low
                if self.kept > self.LINES_KEPT:
                    self.lines.clear()
                    self.kept = 0
                self.lines.setdefault((before[-1], line), []).append((tuple(before[low:]), tuple(stack[low:])))
                self.kept += 1
        before = stack[:]
        if self._take(stack, END) >= 0:
            return None
        if self.semicolon:
            stack = before
            if self._take(stack, self.semicolon) >= 0 and self._take(stack, END) >= 0:
                return None
        return n, len(line)
