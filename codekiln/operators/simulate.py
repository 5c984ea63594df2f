"""A deterministic trace of simple programs: one row for each step, as changes from the step before.

Programs are read as nested statements and walked in order. Conditions are decided
if they are literals or compare whole numbers, else the first way is taken and a
warning given; loops run at most `loop_cap` times. Values are the texts of their
expressions. Steps hold what changes; states (heap totals, a variable's value) are
made from them by windows over each file's steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codekiln.session import spread

TRACE = "file_id string, step_index int, event_type string, line int, detail string, variable string, value string, decision string, iteration int, loop_kind string, scope_id int, heap string, bytes long, warning string"
_COLUMNS = [c.split()[0] for c in TRACE.split(", ")]

_DECLARED = re.compile(r"^(?!return\b|delete\b|throw\b|goto\b|using\b|new\b|else\b|break\b|continue\b)[A-Za-z_][\w:<>,\s*&]*?[\s*&]([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:([-+*/%]?=)\s*(.+))?$", re.S)
_ASSIGNED = re.compile(r"^([A-Za-z_]\w*)\s*([-+*/%]?=)(?!=)\s*(.+)$", re.S)
_FREED = re.compile(r"^(delete)(?:\s*\[\s*\])?\s+([A-Za-z_]\w*)$|^(?:std::)?(free)\s*\(\s*([A-Za-z_]\w*)\s*\)$")
_CONTROL = re.compile(r"^(else\s+if|if|for|while|else|switch|do|try|catch)\b\s*")
_COMPARED = re.compile(r"^(-?\d+)\s*(==|!=|<=|>=|<|>)\s*(-?\d+)$")
_FUNCTION = re.compile(r"([A-Za-z_]\w*)\s*\(")
_HOLDS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
UNSUPPORTED = ("switch", "do", "goto", "try", "catch")


@dataclass
class Statement:
    line: int
    text: str
    body: list[Statement] | None = None
    otherwise: list[Statement] | None = field(default=None)


def _pieces(code: str) -> Iterator[tuple[str, int, str]]:
    """(text, line, what ends it: ; { or }) of the code without comments and directives."""
    held, line, start, depth = [], 1, 0, 0
    for m in re.finditer(r'//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\n|.', code, re.S | re.M):
        t = m[0]
        if t[0] == "\n":
            line += 1
            held.append(" ")
        elif t.startswith(("//", "/*")) or t.lstrip()[:1] == "#":
            line += t.count("\n")
        elif t in ";{}" and depth == 0:
            yield "".join(held).strip(), start or line, t
            held, start = [], 0
        else:
            depth = max(0, depth + (t in "([") - (t in ")]"))
            if not t.isspace() and not start:
                start = line
            held.append(t)
    if (rest := "".join(held).strip()):
        yield rest, start or line, ";"


def _head(text: str) -> tuple[str, str, str]:
    """keyword, content of its brackets, and what follows, of a control statement."""
    m = _CONTROL.match(text)
    word, rest = re.sub(r"\s+", " ", m[1]), text[m.end() :]
    if not rest.startswith("("):
        return word, "", rest
    depth = 0
    for k, c in enumerate(rest):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return word, rest[1:k].strip(), rest[k + 1 :].strip()
    return word, rest[1:].strip(), ""


def parse_statements(code: str) -> list[Statement]:
    """Nested statements. An initializer in braces stays part of its statement."""
    stack: list[list[Statement]] = [[]]
    pending = ""
    for text, line, end in _pieces(code):
        text = pending + text
        if end == "{" and re.search(r"[=,(]\s*$|\breturn$", text):
            pending = text + "{"
            continue
        if pending.count("{") and end == "}" and text.count("{") > text.count("}"):
            pending = text + "}"
            continue
        pending = ""
        if end == "}":
            if text:
                _add(stack[-1], text, line, None)
            if len(stack) > 1:
                stack.pop()
        elif end == "{":
            body: list[Statement] = []
            _add(stack[-1], text, line, body)
            stack.append(body)
        elif text:
            _add(stack[-1], text, line, None)
    return stack[0]


def _add(block: list[Statement], text: str, line: int, body: list[Statement] | None) -> None:
    if body is None and (m := _CONTROL.match(text)) and m[1] != "do":
        word, content, rest = _head(text)
        if rest and word in ("if", "else", "else if", "for", "while"):
            inner: list[Statement] = []
            _add(inner, rest, line, None)
            text, body = f"{word} ({content})" if word != "else" else word, inner
    if text.startswith("else") and block and (last := _last_if(block[-1])) is not None:
        last.otherwise = [Statement(line, text[4:].strip(), body)] if text[4:].strip() else body or []
    else:
        block.append(Statement(line, text, body))


def _last_if(s: Statement) -> Statement | None:
    """The if that an else behind it belongs to."""
    if not s.text.startswith("if"):
        return None
    while s.otherwise and s.otherwise[0].text.startswith("if"):
        s = s.otherwise[0]
    return s if s.otherwise is None else None


def decide(condition: str) -> bool | None:
    """True or False for literals and comparisons of whole numbers, else None."""
    c = condition.strip()
    if c.lower() in ("true", "false"):
        return c.lower() == "true"
    if re.fullmatch(r"-?\d+", c):
        return int(c) != 0
    m = _COMPARED.match(c)
    return _HOLDS[m[2]](int(m[1]), int(m[3])) if m else None


def for_plan(control: str, cap: int) -> tuple[int, bool | None, str | None, int, int]:
    """(rounds, decision or None if undecided, variable, start, step) of a for statement; a capped loop has no variable."""
    parts = [p.strip() for p in control.split(";")]
    first = re.search(r"([A-Za-z_]\w*)\s*=\s*(-?\d+)$", parts[0])
    limit = re.match(r"([A-Za-z_]\w*)\s*(<=|>=|<|>)\s*(-?\d+)$", parts[1]) if len(parts) == 3 else None
    if not first or not limit or first[1] != limit[1]:
        return cap, None, None, 0, 0
    v, start, bound, update = first[1], int(first[2]), int(limit[3]), parts[2]
    changed = re.fullmatch(rf"(?:(\+\+|--)\s*{v}|{v}\s*(\+\+|--)|{v}\s*([-+])=\s*(\d+))", update)
    if not changed:
        return cap, None, None, 0, 0
    step = (1 if "+" in (changed[1] or changed[2] or changed[3]) else -1) * int(changed[4] or 1)
    if step == 0:
        return cap, None, None, 0, 0
    holds, rounds, at = _HOLDS[limit[2]], 0, start
    while rounds < cap and holds(at, bound):
        rounds, at = rounds + 1, at + step
    return (rounds, True, None, 0, 0) if rounds >= cap else (rounds, rounds > 0, v, start, step)


def allocated(expression: str) -> tuple[str, int | None] | None:
    """How memory is taken in an expression, and its bytes if they are literals."""
    if m := re.search(r"\b(malloc|calloc|realloc)\s*\(([^()]*)\)", expression):
        numbers = [int(x) if re.fullmatch(r"\s*\d+\s*", x) else None for x in m[2].split(",")]
        if m[1] == "malloc" and len(numbers) == 1:
            return "malloc", numbers[0]
        if m[1] == "calloc" and len(numbers) == 2:
            return "calloc", numbers[0] * numbers[1] if None not in numbers else None
        return m[1], numbers[-1]
    return ("new", None) if re.search(r"\bnew\b|\bmake_(?:unique|shared)\s*<", expression) else None


class _Tracer:
    """Gives the steps as they arise; none are kept."""

    def __init__(self, cap: int) -> None:
        self.cap, self.scopes, self.next_scope, self.bound = cap, [0], 1, {}

    def step(self, event: str, line: int, detail: str = "", **more: object) -> dict:
        return {"event_type": event, "line": line, "detail": detail, "scope_id": self.scopes[-1], **more}

    def inside(self, body: list[Statement]) -> Iterator[dict]:
        self.scopes.append(self.next_scope)
        self.next_scope += 1
        yield from self.run(body)
        self.scopes.pop()

    def run(self, block: list[Statement]) -> Iterator[dict]:
        for s in block:
            yield from self.one(s)

    def one(self, s: Statement) -> Iterator[dict]:
        if not s.text:
            yield from self.inside(s.body or [])
            return
        yield self.step("line-enter", s.line, s.text)
        control = _CONTROL.match(s.text)
        word = control[1] if control else s.text.split(" ")[0].split("(")[0]
        if word in UNSUPPORTED:
            yield self.step("unsupported", s.line, word, warning="unsupported_construct")
            yield from self.run(s.body or [])
        elif freed := _FREED.match(s.text):
            name = freed[2] or freed[4]
            yield self.step("statement", s.line, f"free {name}", variable=name, heap="free", bytes=self.bound.pop(name, None))
        elif word in ("if", "else if"):
            yield from self.branch(s)
        elif word == "for":
            yield from self.loop(s, "for", *for_plan(_head(s.text)[1], self.cap))
        elif word == "while":
            way = decide(_head(s.text)[1])
            yield from self.loop(s, "while", 0 if way is False else self.cap, way, None, 0, 0)
        elif s.body is not None:
            yield from self.block(s)
        elif m := _DECLARED.match(s.text):
            yield from self.assign(s, "declare", m[1], m[2] or "=", m[3])
        elif m := _ASSIGNED.match(s.text):
            yield from self.assign(s, "assign", m[1], m[2], m[3])
        elif word == "return":
            yield self.step("return", s.line, s.text)
        else:
            taken = allocated(s.text)
            yield self.step("statement", s.line, s.text, **({"heap": "allocate", "bytes": taken[1]} if taken else {}))

    def branch(self, s: Statement) -> Iterator[dict]:
        condition = _head(s.text)[1]
        way = decide(condition)
        decision = "indeterminate" if way is None else str(way).lower()
        yield self.step("evaluate", s.line, condition, decision=decision, warning="indeterminate_condition" if way is None else None)
        yield self.step("branch", s.line, "if" if way is not False else "else", decision=decision)
        if way is not False:
            yield from self.inside(s.body or [])
        elif s.otherwise:
            yield from self.inside(s.otherwise)

    def loop(self, s: Statement, kind: str, rounds: int, way: bool | None, variable: str | None, start: int, step: int) -> Iterator[dict]:
        decision = "indeterminate" if way is None else str(way).lower()
        capped = rounds >= self.cap
        yield self.step("evaluate", s.line, _head(s.text)[1], decision=decision, loop_kind=kind, warning="indeterminate_condition" if way is None else None)
        for k in range(rounds):
            yield self.step("loop-iteration", s.line, kind, iteration=k + 1, loop_kind=kind, variable=variable, value=str(start + k * step) if variable else None)
            yield from self.inside(s.body or [])
        yield self.step("loop-exit", s.line, kind, iteration=rounds, loop_kind=kind, warning="loop_cap" if capped else None)

    def block(self, s: Statement) -> Iterator[dict]:
        header = _FUNCTION.search(s.text)
        if header is None or re.match(r"(?:class|struct|union|enum|namespace)\b", s.text):
            yield from self.inside(s.body or [])
            return
        yield self.step("function-enter", s.line, header[1])
        self.scopes.append(self.next_scope)
        self.next_scope += 1
        for part in s.text[header.end() :].rsplit(")", 1)[0].split(","):
            if m := re.search(r"([A-Za-z_]\w*)\s*(?:\[\s*\])?$", part.split("=")[0].strip()):
                if m[1] != "void":
                    yield self.step("declare", s.line, "parameter", variable=m[1])
        yield from self.run(s.body or [])
        self.scopes.pop()
        yield self.step("function-exit", s.line, header[1])

    def assign(self, s: Statement, event: str, name: str, operator: str, expression: str | None) -> Iterator[dict]:
        taken = allocated(expression or "")
        if taken:
            self.bound[name] = taken[1]
        value = expression if operator == "=" or expression is None else f"{name} {operator} {expression}"
        yield self.step(event, s.line, s.text, variable=name, value=value, **({"heap": "allocate", "bytes": taken[1]} if taken else {}))


class _Counting(_Tracer):
    """Gives each step of a loop's body once, with how many times it arises: the rounds of a loop are alike in all that a summary counts."""

    def loop(self, s: Statement, kind: str, rounds: int, way: bool | None, variable: str | None, start: int, step: int) -> Iterator[dict]:
        yield self.step("evaluate", s.line, loop_kind=kind, warning="indeterminate_condition" if way is None else None)
        if rounds:
            yield self.step("loop-iteration", s.line, kind, loop_kind=kind, times=rounds)
            for own in self.inside(s.body or []):
                own["times"] = own.get("times", 1) * rounds
                yield own
        yield self.step("loop-exit", s.line, kind, loop_kind=kind, warning="loop_cap" if rounds >= self.cap else None)


def summary_of(code: str, loop_cap: int = 20) -> tuple[int, int, int, int, int]:
    """(steps, lines, warnings, cap_hits, unsupported) of a program's trace, in time in proportion to the program and not to its steps."""
    steps, cap_hits, unsupported, lines, warnings = 1, 0, 0, {code.count("\n") + 1}, set()
    for own in _Counting(loop_cap).run(parse_statements(code)):
        times, warning = own.get("times", 1), own.get("warning")
        steps += times
        lines.add(own["line"])
        if warning:
            warnings.add((warning, own["line"]))
            cap_hits += times * (warning == "loop_cap")
        unsupported += times * (own["event_type"] == "unsupported")
    return steps, len(lines), len(warnings), cap_hits, unsupported


def trace_steps(code: str, loop_cap: int = 20, most_steps: int | None = None) -> Iterator[dict]:
    """The steps of one program as they arise; the last is `end`, or `step-limit` where most_steps is given and more would follow."""
    line = code.count("\n") + 1
    for k, step in enumerate(_Tracer(loop_cap).run(parse_statements(code))):
        if k == most_steps:
            yield {"event_type": "step-limit", "line": line, "detail": "", "scope_id": 0, "warning": "step_limit"}
            return
        yield step
    yield {"event_type": "end", "line": line, "detail": "", "scope_id": 0, "warning": None}


def trace_code(code: str, loop_cap: int = 20, most_steps: int | None = None) -> list[dict]:
    return list(trace_steps(code, loop_cap, most_steps))


def simulate(files: DataFrame, key: str, code: str, loop_cap: int = 20, most_steps: int | None = None) -> DataFrame:
    """TRACE rows of each file. loop_cap is 1 to 200; only it bounds a trace, unless most_steps is given. Null code gives only an end; ids may be null."""
    if not 1 <= loop_cap <= 200:
        raise ValueError("the loop cap is 1 to 200")

    whole = {"iteration": "Int32", "bytes": "Int64"}

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=whole.get(c, object)) for c in _COLUMNS})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for batch in batches:
            for one, text in zip(batch["file_id"], batch["code"], strict=True):
                for k, step in enumerate(trace_steps(text or "", loop_cap, most_steps)):
                    step["file_id"], step["step_index"] = one, k
                    held.append(step)
                    if len(held) >= 20_000:
                        yield table(held)
                        held = []
        yield table(held)

    return spread(files.select(F.col(key).cast("string").alias("file_id"), F.col(code).alias("code"))).mapInPandas(run, TRACE)


def heap_running(events: DataFrame, keys: list[str], order: list[str], kind: str, amount: str) -> DataFrame:
    """events with allocations, frees, live, bytes_allocated, bytes_freed, bytes_live, unknown_allocations, unknown_frees so far."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken, freed = F.col(kind) == "allocate", F.col(kind) == "free"
    total = lambda x: F.coalesce(F.sum(x).over(so_far), F.lit(0)).cast("long")
    out = events.withColumns(
        {
            "allocations": total(taken.cast("int")),
            "frees": total(freed.cast("int")),
            "bytes_allocated": total(F.when(taken, F.col(amount))),
            "bytes_freed": total(F.when(freed, F.col(amount))),
            "unknown_allocations": total((taken & F.col(amount).isNull()).cast("int")),
            "unknown_frees": total((freed & F.col(amount).isNull()).cast("int")),
        }
    )
    return out.withColumns({"live": F.greatest(F.lit(0), F.col("allocations") - F.col("frees")), "bytes_live": F.greatest(F.lit(0), F.col("bytes_allocated") - F.col("bytes_freed"))})


def freed_bytes(events: DataFrame, keys: list[str], order: list[str], kind: str, name: str, amount: str) -> DataFrame:
    """events with freed: for a free, the bytes of the last allocation of that name before it; null if freed since, or never taken."""
    before = Window.partitionBy(*keys, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(kind).isin("allocate", "free"), F.struct(kind, amount)), ignorenulls=True).over(before)
    return events.withColumn("last_event", last).withColumn("freed", F.when((F.col(kind) == "free") & (F.col(f"last_event.{kind}") == "allocate"), F.col(f"last_event.{amount}"))).drop("last_event")


def variable_values(trace: DataFrame) -> DataFrame:
    """trace steps with current: the latest value given to the step's variable in its file."""
    upto = Window.partitionBy("file_id", "variable").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)
    return trace.filter("variable is not null").withColumn("current", F.last("value", ignorenulls=True).over(upto))


def trace_summary(trace: DataFrame) -> DataFrame:
    """file_id, steps, lines, warnings (distinct by kind, line), cap_hits, unsupported, status."""
    grouped = trace.groupBy("file_id").agg(
        F.count("*").alias("steps"),
        F.countDistinct("line").alias("lines"),
        F.countDistinct(F.when(F.col("warning").isNotNull(), F.struct("warning", "line"))).alias("warnings"),
        F.count_if(F.col("warning") == "loop_cap").alias("cap_hits"),
        F.count_if(F.col("event_type") == "unsupported").alias("unsupported"),
        F.count_if(F.col("event_type") == "step-limit").alias("left_off"),
    )
    return grouped.withColumn("status", F.when((F.col("unsupported") > 0) | (F.col("left_off") > 0), "partial").otherwise("ok")).drop("left_off")


def trace_summaries(files: DataFrame, key: str, code: str, loop_cap: int = 20) -> DataFrame:
    """trace_summary of whole traces, without making their steps. Counts stay at 2^63 - 1 where there would be more."""
    if not 1 <= loop_cap <= 200:
        raise ValueError("the loop cap is 1 to 200")
    names = ["steps", "lines", "warnings", "cap_hits", "unsupported"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [summary_of(text or "", loop_cap) for text in batch["code"]]
            counts = {name: pd.Series([min(x[k], (1 << 63) - 1) for x in found], dtype="int64") for k, name in enumerate(names)}
            yield pd.DataFrame({"file_id": batch["file_id"], **counts, "status": pd.Series(["partial" if x[4] else "ok" for x in found], dtype=object)})

    rows = spread(files.select(F.col(key).cast("string").alias("file_id"), F.col(code).alias("code")))
    return rows.mapInPandas(run, "file_id string, " + ", ".join(f"{name} long" for name in names) + ", status string")


def frames(trace: DataFrame) -> DataFrame:
    """trace steps with function: the one that was entered last and is not left yet.

    Enters and exits count a depth; the innermost function is the last enter at the
    depth of the step.
    """
    order = Window.partitionBy("file_id").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("event_type") == "function-enter", 1).when(F.col("event_type") == "function-exit", -1).otherwise(0)
    deep = trace.withColumn("depth", F.sum(change).over(order))
    same = Window.partitionBy("file_id", "depth").orderBy("step_index").rowsBetween(Window.unboundedPreceding, 0)
    entered = F.last(F.when(F.col("event_type") == "function-enter", F.col("detail")), ignorenulls=True).over(same)
    return deep.withColumn("function", F.when(F.col("depth") > 0, entered)).drop("depth")
