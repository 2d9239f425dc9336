"""Verdict parsing, clamping, unswap and win-rate properties."""

import json

import pytest
from pyspark.sql import functions as F

from tuneval.operators import verdicts as V

DIMS = ["instruction_following", "correctness", "clarity", "completeness",
        "structured_output_validity", "hallucination_risk"]


def verdict(a, b, winner, drop=()):
    sa = {d: v for d, v in zip(DIMS, a) if d not in drop}
    return json.dumps({"response_a_scores": sa, "response_b_scores": dict(zip(DIMS, b)),
                       "winner": winner, "justification": "j"})


def run(spark, rows):
    df = spark.createDataFrame(rows, "comparison string, prompt_id long, swap int, raw string")
    return V.normalize_verdicts(V.parse_verdicts(df))


def test_parse_paths(spark):
    rows = [("c", 1, 0, verdict([4] * 6, [2] * 6, "A")),
            ("c", 2, 0, "Verdict: " + verdict([4] * 6, [2] * 6, "B") + " End."),
            ("c", 3, 0, "no verdict"), ("c", 4, 0, "{broken} {json}"), ("c", 5, 0, "[1, 2]")]
    out = {r.prompt_id: r for r in run(spark, rows).collect()}
    assert out[1].error is None and out[1].winner == "A"
    assert out[2].error is None and out[2].winner == "B"
    assert out[3].error == "Could not parse judge response"
    assert out[4].error == "embedded JSON does not parse"
    assert out[5].error == "verdict is not an object"


def test_clamp_default_and_winner_normalise(spark):
    rows = [("c", 1, 0, verdict([0, 6, 3, 4.7, 5, 1], [1] * 6, "maybe", drop=("clarity",)))]
    r = run(spark, rows).collect()[0]
    assert r.scores_a == {"instruction_following": 1, "correctness": 5, "clarity": 3,
                          "completeness": 4, "structured_output_validity": 5, "hallucination_risk": 1}
    assert r.winner == "TIE"
    assert r.raw_scores_a["completeness"] == pytest.approx(4.7)
    assert "clarity" not in r.raw_scores_a


@pytest.mark.parametrize("bad", ["abc", None, [2], {"a": 1}, "4.5", ""])
def test_a_score_that_is_no_number_is_an_error(spark, bad):
    rows = [("c", 1, 0, verdict([bad, 3, 3, 3, 3, 3], [3] * 6, "A")),
            ("c", 2, 1, verdict([3] * 6, [3, 3, bad, 3, 3, 3], "A"))]
    out = run(spark, rows)
    for r in out.collect():
        assert r.error == "invalid score" and r.winner is None and r.scores_a is None and r.scores_b is None
    w = V.win_rates(out).collect()[0]
    assert w.error_count == 2 and w.total_pairs == 0


def test_scores_that_int_takes(spark):
    r = run(spark, [("c", 1, 0, verdict(["4", " 2 ", "-7", True, False, 1e9], [-0.5] * 6, "A"))]).collect()[0]
    assert [r.scores_a[d] for d in DIMS] == [4, 2, 1, 1, 1, 5] and set(r.scores_b.values()) == {1}
    assert r.error is None and "clarity" not in r.raw_scores_a


def test_unswap_is_inverse_of_swap(spark):
    a, b = [5, 4, 3, 2, 1, 5], [1, 1, 2, 2, 3, 3]
    plain = ("c", 1, 0, verdict(a, b, "A"))
    shown_swapped = ("c", 2, 1, verdict(b, a, "B"))   # judge saw B first and preferred it
    out = {r.prompt_id: r for r in run(spark, [plain, shown_swapped]).collect()}
    assert out[1].winner == out[2].winner == "A"
    assert out[1].scores_a == out[2].scores_a and out[1].scores_b == out[2].scores_b


def test_win_rates_sum_to_one_and_errors_apart(spark):
    rows = [("c", i, i % 2, verdict([3] * 6, [3] * 6, w)) for i, w in
            enumerate(["A", "B", "TIE", "A", "x"])] + [("c", 9, 0, "garbage")]
    w = V.win_rates(run(spark, rows)).collect()[0]
    assert w.total_pairs == 5 and w.error_count == 1
    assert w.win_rate_a + w.win_rate_b + w.tie_rate == pytest.approx(1.0)
    assert w.pct_a + w.pct_b + w.pct_tie <= 100


def test_dimension_averages_zero_when_missing(spark):
    rows = [("c", 1, 0, "no verdict")]
    d = V.dimension_averages(run(spark, rows)).collect()
    assert len(d) == 6 and all(r.response_a_mean == 0.0 for r in d)


def test_row_mean_null_when_empty(spark):
    df = spark.createDataFrame([({},), ({"a": 2.0, "b": 4.0},)], "m map<string,double>")
    assert [r[0] for r in df.select(V.row_mean(F.col("m"))).collect()] == [None, 3.0]
