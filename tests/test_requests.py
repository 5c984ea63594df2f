import pytest
from pyspark.sql import functions as F

from codekiln.operators import requests


@pytest.mark.parametrize(
    ("kind", "payload", "problems"),
    [
        ("benchmark", '{"runs": 5, "warmupRuns": 0, "compiler": "g++", "args": ["a", "b"], "extraArgs": [], "code": ""}', []),
        ("benchmark", '{"runs": 0, "warmupRuns": 11, "compiler": "msvc", "args": [1]}', ["args: of another kind", "compiler: out of range", "runs: out of range", "warmupRuns: out of range"]),
        ("benchmark", '{"runs": "5", "warmupRuns": 1.5, "sourcePath": "", "code": null}', ["code: of another kind", "runs: of another kind", "sourcePath: out of range", "warmupRuns: of another kind"]),
        ("benchmark", '{"Runs": 5}', ["Runs: unknown"]),
        ("benchmark", "{}", []),
        ("simulate", '{"maxLoopIterations": 200, "language": "cpp"}', []),
        ("simulate", '{"maxLoopIterations": 201, "language": "c"}', ["language: out of range", "maxLoopIterations: out of range"]),
        ("create", '{"kind": "file"}', ["targetPath: missing"]),
        ("create", '{"kind": "link", "targetPath": "x"}', ["kind: out of range"]),
        ("compare", '{"benchmarkResult": {"a": 1}}', []),
        ("compare", '{"benchmarkResult": [1]}', ["benchmarkResult: of another kind"]),
        ("optimize", '{"skipMl": true}', []),
        ("optimize", '{"skipMl": 1}', ["skipMl: of another kind"]),
        ("history", "[]", ["no object"]),
        ("history", '{"limit": 5', ["no object"]),
        ("history", "", ["no object"]),
        ("history", None, ["no object"]),
    ],
)
def test_requests(spark, kind, payload, problems):
    rows = spark.createDataFrame([(payload, "x")], "payload string, problem string")
    assert requests.checked_requests(rows, "payload", kind).first()["problems"] == problems


def test_arguments_are_merged(spark):
    rows = spark.createDataFrame([(["-O2", "-a", "-O2"],), ([],), (None,), (["-a", "-b"],)], "xs array<string>")
    got = [r[0] for r in rows.select(requests.merged_arguments(["-a"], F.col("xs"))).collect()]
    assert got == [["-a", "-O2"], ["-a"], ["-a"], ["-a", "-b"]]
    assert rows.select(requests.merged_arguments([], F.col("xs"))).first()[0] == ["-O2", "-a"]
