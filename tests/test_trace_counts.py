import duckdb
import pytest

from codekiln.operators import simulate

PROGRAMS = [
    "",
    "int f() { for (int i = 0; i < 3; i++) { int x = i; free(p); } return 1; }",
    "void f(int a, int b) { while (ready) { if (a) { switch (a) { x(); } } else { y = 2; } } for (;;) { for (int k = 0; k < 50; ++k) { z += k; } } }",
    "while (false) { x = 1; } while (1) { while (open) { int* p = new int; delete p; } }",
    "for (int i = 5; i < 3; i++) { a = 1; }\nfor (int i = 0; i < 20; i += 2) { do { b(); } while (c); }",
    "for (int i = 0; i < 9; i++) for (int j = 0; j < 9; j++) { try { s(); } catch (...) { t(); } }",
]


@pytest.mark.parametrize("cap", [1, 2, 7, 20])
def test_counts_are_those_of_the_steps(cap):
    rows = duckdb.connect().execute("select code from '/root/testdata/sf0.001/files.parquet' where code is not null").fetchall()
    for code in [*PROGRAMS, *(r[0] for r in rows)]:
        steps = simulate.trace_code(code, cap)
        warned = [(s["warning"], s["line"]) for s in steps if s.get("warning")]
        want = (len(steps), len({s["line"] for s in steps}), len(set(warned)), sum(w == "loop_cap" for w, _ in warned), sum(s["event_type"] == "unsupported" for s in steps))
        assert simulate.summary_of(code, cap) == want


def test_the_query_agrees_and_deep_loops_end(spark):
    deep = "for (int a = 0; a < 99; a++) { " * 18 + "x = 1;" + " }" * 18
    rows = spark.createDataFrame([(str(k), c, "x") for k, c in enumerate(PROGRAMS)] + [(None, None, "y"), ("7", "x = 1;", "z")], "id string, code string, file_id string")
    got = {tuple(r) for r in simulate.trace_summaries(rows, "id", "code").collect()}
    columns = ["file_id", "steps", "lines", "warnings", "cap_hits", "unsupported", "status"]
    assert got == {tuple(r) for r in simulate.trace_summary(simulate.simulate(rows, "id", "code")).select(columns).collect()}
    far = simulate.trace_summaries(spark.createDataFrame([("d", deep)], "id string, code string"), "id", "code").first()
    assert far["steps"] == (1 << 63) - 1 and far["lines"] == 1
