import json

from codekiln.operators import nested


def test_every_level_is_a_table(spark):
    doc = {
        "file": "a.cpp",
        "features": {"scope": "f", "thresholds": {"loops": 8, "nestingDepth": 4}},
        "semanticChecks": json.dumps({"scope": "s", "issues": [{"title": "t"}]}),
        "codeSmells": {"scope": "c"},
        "complexity": {"scope": "e", "time": {"bigO": "O(1)"}},
    }
    rows = spark.createDataFrame([(7, "t", json.dumps(doc))], "analysis_id long, received_at string, payload string")
    emission = nested.emit_records(rows)
    root = nested.flat_table(emission, "analysis").first()
    assert (root["record_key"], root["parent_key"], root["fields"]) == ("7", None, {"file": "a.cpp"})
    scopes = {tag: nested.flat_table(emission, tag).first()["scope"] for tag in ("features", "semantic_checks", "code_smells", "complexity_estimate")}
    assert scopes == {"features": "f", "semantic_checks": "s", "code_smells": "c", "complexity_estimate": "e"}
    assert nested.flat_table(emission, "features").first()["thresholds"] == (8, 4)
    keys = {r["record_key"] for r in emission.collect()}
    assert {r["parent_key"] for r in emission.collect()} <= keys | {None}
