import json

from pyspark.sql import functions as F

from codekiln.streaming import pipelines


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"file_id": "f", "compiler": "g++", "chunk_no": 1, "stderr": "a.cpp:1:2: error: odd\nnote: x"}))
    query = pipelines.diagnostics_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("messages").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["message"] for r in spark.table("messages").collect()] == ["odd"]
    assert pipelines.unmapped_messages(spark.table("messages"), ["strange"]).count() == 1
    assert pipelines.unmapped_messages(spark.table("messages"), ["od+"]).count() == 0


def test_staging_keeps_the_last_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, marks = str(tmp_path / "staged"), str(tmp_path / "marks")

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        edits = spark.readStream.schema(pipelines.EDIT_SCHEMA).json(str(tmp_path / "in"))
        pipelines.stage_edits(edits, target, marks, once=True).awaitTermination(60)

    assert pipelines.staged(spark, target) is None
    put("1.json", [{"path": "a", "seq": 2, "content": "new"}, {"path": "a", "seq": 1, "content": "old"}, {"path": "b", "seq": 1, "content": "x"}])
    put("2.json", [{"path": "b", "seq": 3, "content": "y"}])
    assert {r["path"]: r["content"] for r in pipelines.staged(spark, target).collect()} == {"a": "new", "b": "y"}


def test_staging_adds_changes_and_compacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, marks = tmp_path / "staged", str(tmp_path / "marks")
    want = {}
    for k in range(7):
        rows = [{"path": f"p{(k + n) % 4}", "seq": 10 * k + n, "content": f"{k}.{n}"} for n in range(3)]
        want |= {r["path"]: r["content"] for r in rows}
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        edits = spark.readStream.schema(pipelines.EDIT_SCHEMA).json(str(tmp_path / "in"))
        pipelines.stage_edits(edits, str(target), marks, once=True, compact_every=2).awaitTermination(60)
        assert {r["path"]: r["content"] for r in pipelines.staged(spark, str(target)).collect()} == want
    names = lambda kind: sorted(int(p.name.split("=")[1]) for p in (target / kind).iterdir())
    assert names("whole") == [3, 5] and names("changes") == [4, 5, 6]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("t", float(k), f"2024-01-01 {k:02d}:10:00") for k in range(6)], "run_target string, duration_ms double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(pipelines.RUN_SCHEMA).parquet(str(tmp_path / "runs"))
    query = pipelines.windowed_runs(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("windows").count() == 5
    pipelines.append_stream(stream, str(tmp_path / "kept"), str(tmp_path / "marks")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 6
