import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codekiln.functions import score, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_regex_score_of_a_known_pattern(spark):
    assert value(spark, score.regex_match_score(F.lit(r"expected\s+'\}'"), F.lit("expected '}'"))) == pytest.approx(0.927333, abs=1e-6)


def test_similarity_and_overlap_bounds(spark):
    rows = spark.createDataFrame([("a b", "b a"), ("", ""), ("", "x"), ("same words", "same words"), (None, "x"), (None, None)], "a string, b string")
    got = rows.select(text.token_overlap(F.col("a"), F.col("b")), text.edit_similarity(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert got[1][1] == 1.0 and got[3][1] == 1.0 and got[5][1] == 1.0 and all(0 <= g[1] <= 1 for g in got)


def test_rounding_goes_up_at_a_half(spark):
    assert value(spark, score.rounded(F.lit(0.0005))) == 0.001
    assert value(spark, score.rounded(F.lit(-0.0005))) == 0.0


def test_ascii_boundaries(spark):
    assert value(spark, F.regexp_count(F.lit("newé new énew new"), F.lit(text.ascii_word("new")))) == 4


def test_rendering_is_one_pass(spark):
    params = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("x"))
    assert value(spark, text.rendered(F.lit("{{a}}-{{b}}-{{c}}!"), params)) == "{{b}}-x-!"


def test_sentences_and_cases(spark):
    assert value(spark, text.first_sentence(F.lit("One.  Two."))) == "One."
    assert value(spark, text.as_sentence(F.lit("  add   it "))) == "Add it."
    assert value(spark, text.as_sentence(F.lit(""))) == ""
    assert value(spark, text.action_of(F.lit("Check the address"))) == "edit"


def test_feature_labels(spark):
    labels = {"loops_total": "Loops"}
    assert value(spark, text.feature_label(F.lit("loops_total"), labels)) == "Loops"
    assert value(spark, text.feature_label(F.lit("stl_total"), labels)) == value(spark, text.feature_label(F.lit("stl_total"))) == "Stl total"


def test_complexity_list(spark):
    def time(loops, depth, recursion, stl, many=False, deep=False):
        growth, sure = score.time_complexity(F.lit(loops), F.lit(depth), F.lit(recursion), F.lit(stl), F.lit(many), F.lit(deep))
        return value(spark, F.struct(growth.alias("a"), sure.alias("b")))

    assert tuple(time(0, 0, 0, 0)) == ("O(1)", "medium")
    assert tuple(time(1, 1, 0, 0)) == ("O(n)", "high")
    assert tuple(time(2, 2, 0, 0)) == ("O(n^2)", "high")
    assert tuple(time(0, 0, 0, 2)) == ("O(n log n)", "medium")
    assert tuple(time(9, 5, 0, 0, True, True)) == ("O(n^5)", "low")
    assert value(spark, score.big_o_rank(F.lit("O(n^4)"))) == 0
    assert 6 < value(spark, score.big_o_rank_extended(F.lit("O(n^4)"))) < 7


def test_calibration_never_exceeds_the_rule(spark):
    got = value(spark, score.calibrated(F.lit(2.0), F.lit(1.0), F.lit(0.15), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.9)))
    assert got == 0.9
    assert value(spark, score.calibrated(F.lit(0.57), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.85))) == pytest.approx(0.456)


def test_fences_and_json(spark):
    assert value(spark, text.largest_fence(F.lit("a\n```cpp\nx\n```\n```\nlonger\n```"))) == "longer"
    assert value(spark, text.largest_fence(F.lit(" plain "))) == "plain"
    assert value(spark, text.tolerant_json(F.lit("{oops"), "a int")) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=30))
def test_order_statistics(spark, values):
    import math

    from codekiln.operators.profiling import timing_summary

    rows = spark.createDataFrame([("t", v) for v in values], "k string, v double")
    got = timing_summary(rows, ["k"], "v").first()
    whole = sorted(math.floor(v * 1000 + 0.5) for v in values)
    n = len(whole)
    assert got["run_count"] == n and got["p95_ms"] == whole[max(0, math.ceil(n * 0.95) - 1)] / 1000
    assert got["median_ms"] == math.floor((whole[(n - 1) // 2] + whole[n // 2] + 1) / 2) / 1000
    assert got["p95_ms"] >= got["median_ms"]
