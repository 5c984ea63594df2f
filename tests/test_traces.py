from codekiln.operators import simulate

MATRIX = "void product() {\n for (int i = 0; i < 60; i++) {\n  for (int j = 0; j < 60; j++) {\n   for (int k = 0; k < 60; k++) {\n    c = 1;\n   }\n  }\n }\n}\nint after() {\n return 1;\n}\n"


def test_three_capped_loops_are_traced_to_the_end(spark):
    rows = simulate.trace_code(MATRIX)
    assert rows[-1]["event_type"] == "end" and [r["detail"] for r in rows if r["event_type"] == "function-exit"] == ["product", "after"]
    assert sum(r.get("warning") == "loop_cap" for r in rows) == 1 + 20 + 400
    files = spark.createDataFrame([("a", MATRIX)], "id string, code string")
    whole = simulate.trace_summary(simulate.simulate(files, "id", "code")).first()
    assert (whole["steps"], whole["cap_hits"], whole["status"]) == (len(rows), 421, "ok")
    cut = simulate.trace_summary(simulate.simulate(files, "id", "code", most_steps=100)).first()
    assert (cut["steps"], cut["status"]) == (101, "partial")
