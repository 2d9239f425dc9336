"""Thresholds and reports (J1-J19, I8) on literal frames."""

import pytest
from pyspark.sql import functions as F

from tuneval.operators import ablation, forgetting


def test_severity_thresholds_are_strict(spark):
    vals = [-25.0, -20.0, -15.0, -10.0, -7.0, -5.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(forgetting.severity(F.col("x"))).collect()]
    assert got == ["severe", "moderate", "moderate", "mild", "mild", "none", "none"]
    pts = [r[0] for r in df.select(forgetting.severity(F.col("x"), forgetting.SEVERITY_POINTS)).collect()]
    assert pts == ["moderate", "moderate", "mild", "mild", "mild", "none", "none"]


def test_forgetting_flag_edges(spark):
    df = spark.createDataFrame([(-10.0, 0.0, 0.0), (-10.01, 0.0, 0.0), (0.0, -5.0, 0.0),
                                (0.0, 0.0, -5.01)], "j double, r double, b double")
    got = [r[0] for r in df.select(forgetting.forgetting_flag(F.col("j"), F.col("r"), F.col("b"))).collect()]
    assert got == [False, True, False, True]


def test_compare_missing_is_zero(spark):
    m = spark.createDataFrame([("cp1", "rouge1", 0.5), ("cp2", "rouge1", 0.4), ("cp2", "rouge2", 0.1)],
                              "checkpoint string, metric string, value double")
    c = {r.metric: r for r in forgetting.compare_checkpoints(m, [("cp1", "cp2")], ("rouge1", "rouge2")).collect()}
    assert c["rouge1"].percent_change == pytest.approx(-20.0)
    assert c["rouge2"].value_1 == 0.0 and c["rouge2"].percent_change == 0.0


def test_direction_band(spark):
    # change exactly +-0.5 stays "maintained"
    df = spark.createDataFrame([(1, -0.5), (2, -0.51), (3, 0.5), (4, 0.51)], "prompt_id int, change double")
    d = df.withColumn("direction", F.when(F.col("change") < -0.5, "regressed")
                      .when(F.col("change") > 0.5, "improved").otherwise("maintained"))
    b = {r.bucket: r.bucket_size for r in forgetting.example_buckets(d).collect()}
    assert b == {"maintained": 2, "regressed": 1, "improved": 1}


def test_ablation_grid():
    rows = ablation.config_rows()
    assert len(rows) == 11
    names = [r[1] for r in rows]
    assert names[:6] == ["epochs_1", "epochs_2", "epochs_3", "lr_2e-05", "lr_1e-05", "lr_5e-06"]
    assert "datasize_25pct" in names and names[-2:] == ["sequential", "combined"]


def test_loss_curve(spark):
    meta = spark.createDataFrame([(1, 11.3785), (2, 10.6663), (3, 10.81)], "epochs int, training_loss double")
    out = {r.epochs: r for r in ablation.loss_curve(meta).collect()}
    assert out[1].loss_delta is None and out[2].loss_delta == pytest.approx(-0.7122)
    assert out[3].best_epochs == 2


def test_report_na(spark):
    r = spark.createDataFrame([("epochs", "epochs_1", None, None, None, None)],
                              "ablation_type string, variant_name string, json_exact_match_rate double, "
                              "alpaca_judge_win_rate double, forgetting_severity string, primary_metric double")
    row = ablation.report(r).collect()[0]
    assert (row.json_acc, row.alpaca_wr, row.forgetting, row.primary) == ("N/A",) * 4


def test_expand_with_fallback(spark):
    from tuneval.operators import render
    t = spark.createDataFrame([("extraction", "base-e", "in-e"), ("tool_call", "base-t", "in-t")],
                              "task_type string, instruction string, input string")
    v = spark.createDataFrame([("extraction", "v2", "x", 2), ("extraction", "v1", "", 1),
                               ("function_call", "f1", "", 1), ("extraction", "v3", "", 3), ("extraction", "v4", "", 4)],
                              "task_type string, instruction string, input string, position int")
    out = sorted(map(tuple, render.expand_with_fallback(t, v, 3).collect()))
    # matched type takes its variations; unmatched type repeats its base pair n times;
    # variations of a type with no template are not used
    assert out == [("extraction", "v1", ""), ("extraction", "v2", "x"), ("extraction", "v3", "")] + \
        [("tool_call", "base-t", "in-t")] * 3
    twice = render.expand_with_fallback(t.unionByName(t), v, 1).collect()
    assert len(twice) == 4


def test_append_results_keeps_history(spark):
    import tempfile
    path = tempfile.mkdtemp() + "/ablation_results"
    r = spark.createDataFrame([("epochs_1", 0.5)], "variant_name string, primary_metric double")
    ablation.append_results(r, path)
    ablation.append_results(r.withColumn("primary_metric", F.lit(0.6)), path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and "timestamp" in got.columns
    assert sorted(x.primary_metric for x in got.collect()) == [0.5, 0.6]


def test_result_log_counts_a_run_once(spark, monkeypatch):
    import tempfile
    path = tempfile.mkdtemp() + "/log"
    r = spark.createDataFrame([("v", 0.5)], "variant_name string, primary_metric double")
    assert ablation.append_results(r, path, "2024-01-01/a b")
    assert not ablation.append_results(r, path, "2024-01-01/a b")           # a retry

    def killed(p):
        raise RuntimeError("killed before the commit")
    with monkeypatch.context() as m:
        m.setattr(ablation, "quote", lambda s, safe: m.setattr(ablation, "_committed", killed) or s)
        try:
            ablation.append_results(r, path, "second")
        except RuntimeError:
            pass
    assert spark.read.parquet(path).count() == 2                           # what the attempt left
    assert [x.run_id for x in ablation.read_results(spark, path).collect()] == ["2024-01-01/a b"]
    assert ablation.append_results(r, path, "second") and ablation.read_results(spark, path).count() == 2
    # two attempts that both came to commit: the first counts
    spark.createDataFrame([("second", "zz")], "run_id string, attempt string").withColumn(
        "at", F.current_timestamp()).write.mode("append").parquet(path + "_committed")
    assert ablation.read_results(spark, path).count() == 2


def test_guard_stops_an_evaluation(spark):
    import pytest
    from tuneval.plans import evaluate
    rows = [("open", k, cp, "[error: x]" if cp == "cp1" and k < 3 else "fine") for k in range(20)
            for cp in ("cp0", "cp1", "cp2")]
    d = spark.createDataFrame(rows, "suite string, prompt_id long, checkpoint string, response string")
    with pytest.raises(evaluate.TooManyErrors, match="cp1: 3 of 20 responses are errors, more than 10 %"):
        evaluate.guarded(d, 0.1)
    ok = evaluate.guarded(d, 0.15)
    assert ok.columns == d.columns and ok.count() == 60 and evaluate.guarded(d, None) is d
