from codekiln.plans import source_queries


def test_every_line_is_a_cursor(spark, tmp_path):
    spark.createDataFrame([("f", "int aa = 1;\nint bb = 2;\nint cc = 3;")], "file_id string, code string").write.parquet(f"{tmp_path}/files.parquet")
    seen = source_queries.symbol_visibility(spark, str(tmp_path)).collect()
    assert sorted((r["cursor_line"], r["name"]) for r in seen) == [(1, "aa"), (2, "aa"), (2, "bb"), (3, "aa"), (3, "bb"), (3, "cc")]
