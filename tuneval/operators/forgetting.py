"""Checkpoint comparison and forgetting analytics.

Inputs are tidy tables: metrics ``(checkpoint, metric, value)``, judge win
rates per comparison, normalised verdicts. Outputs are small DataFrames; the
findings text is built with column expressions, not on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import top_k
from .verdicts import row_mean

# Metrics compared between checkpoints (open-ended, then JSON).
OPEN_METRICS = ("rouge1", "rouge2", "rougeL", "bertscore_f1")
JSON_METRICS = ("validity_rate", "compliance_rate", "exact_match_rate")
# Forgetting thresholds (percent changes, strict comparisons).
JUDGE_DROP, ROUGE_DROP, BERT_DROP = -10.0, -5.0, -5.0
SEVERITY_PCT = ((-20.0, "severe"), (-10.0, "moderate"), (-5.0, "mild"))
# The report's alternative scale in percentage points.
SEVERITY_POINTS = ((-15.0, "moderate"), (-5.0, "mild"))
CHANGE_BAND = 0.5
DEFAULT_WIN_RATE = 0.5
# The findings' wording by severity.
HEADS = {"none": "✓ NO CATASTROPHIC FORGETTING detected.",
         "mild": "⚠ MILD FORGETTING detected",
         "moderate": "⚠⚠ MODERATE FORGETTING detected",
         "severe": "⚠⚠⚠ SEVERE FORGETTING detected"}
DECLINES = {"mild": "  Judge preference declined slightly: ",
            "moderate": "  Alpaca capabilities degraded noticeably: ",
            "severe": "  Alpaca capabilities severely degraded: "}
CONCLUSION_NONE = ("CONCLUSION: Stage 2 training successfully improved JSON capabilities while "
                   "maintaining or improving general Alpaca instruction-following performance. "
                   "No evidence of catastrophic forgetting.")
CONCLUSION_START = "CONCLUSION: Stage 2 training caused "
CONCLUSION_END = (" degradation of Alpaca capabilities. "
                  "This suggests a tradeoff between JSON specialization and general instruction-following. "
                  "Consider: reduced learning rate, fewer epochs, more diverse Stage 2 data, or task augmentation.")


def pct_change(v1: Column, v2: Column) -> Column:
    """(v2 - v1) / v1 * 100, 0 when v1 <= 0."""
    return F.when(v1 > 0, (v2 - v1) / v1 * 100).otherwise(F.lit(0.0))


def compare_checkpoints(metrics: DataFrame, pairs, names=OPEN_METRICS + JSON_METRICS) -> DataFrame:
    """For each (cp1, cp2) pair and metric: values, absolute and percent
    change; a metric missing on a side counts as 0.

    One pass over the metrics: pivot by checkpoint (one row per metric),
    then explode the requested pairs. No self-join, so the upstream metric
    plan runs once.
    """
    cps = sorted({c for p in pairs for c in p})
    wide = (metrics.where(F.col("metric").isin(*names))
                   .groupBy("metric").pivot("checkpoint", cps).agg(F.first("value")))
    spark = metrics.sparkSession
    all_names = spark.createDataFrame([(m,) for m in names], "metric string")
    w = all_names.join(wide, "metric", "left")
    x = w.select("metric", F.explode(F.array(*[
        F.struct(F.lit(a).alias("checkpoint_1"), F.lit(b).alias("checkpoint_2"),
                 F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias("v1"),
                 F.coalesce(F.col(f"`{b}`"), F.lit(0.0)).alias("v2")) for a, b in pairs])).alias("x"))
    return x.select("x.checkpoint_1", "x.checkpoint_2", "metric",
                    F.round("x.v1", 6).alias("value_1"), F.round("x.v2", 6).alias("value_2"),
                    F.round(F.col("x.v2") - F.col("x.v1"), 6).alias("absolute_change"),
                    F.round(pct_change(F.col("x.v1"), F.col("x.v2")), 6).alias("percent_change"))


def severity(change: Column, scale=SEVERITY_PCT) -> Column:
    """First band whose threshold the change is strictly below."""
    out = None
    for thr, label in scale:
        out = F.when(change < thr, label) if out is None else out.when(change < thr, label)
    return out.otherwise("none")


def forgetting_flag(judge_pct: Column, rouge_pct: Column, bert_pct: Column) -> Column:
    """Judge pct < -10 or ROUGE-L pct < -5 or BERTScore pct < -5."""
    return (judge_pct < JUDGE_DROP) | (rouge_pct < ROUGE_DROP) | (bert_pct < BERT_DROP)


def forgetting_summary(win: DataFrame, metrics: DataFrame, by_category: DataFrame | None = None,
                       cp1="cp1", cp2="cp2", cmp1="cp1_vs_cp0", cmp2="cp2_vs_cp0") -> DataFrame:
    """One row comparing cp1 and cp2.

    Win rates are the challenger's share against the same opponent in two
    comparisons (missing -> 0.5); ROUGE-L/BERTScore come from ``metrics``
    (missing -> 0). ``by_category`` (``evaluate.category_win_rates``, a row
    per category) adds the findings' lines per category.
    """
    def wr(c):
        return F.coalesce(F.max(F.when(F.col("comparison") == c, F.col("win_rate_a"))),
                          F.lit(DEFAULT_WIN_RATE))
    w = win.agg(wr(cmp1).alias("cp1_win_rate"), wr(cmp2).alias("cp2_win_rate"))

    def mv(cp, m):
        return F.coalesce(F.max(F.when((F.col("checkpoint") == cp) & (F.col("metric") == m),
                                       F.col("value"))), F.lit(0.0))
    m = metrics.agg(mv(cp1, "rougeL").alias("cp1_rougeL"), mv(cp2, "rougeL").alias("cp2_rougeL"),
                    mv(cp1, "bertscore_f1").alias("cp1_bertscore"),
                    mv(cp2, "bertscore_f1").alias("cp2_bertscore"))
    # both sides are single aggregate rows: joined on a constant key
    j = w.withColumn("_k", F.lit(1)).join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k").drop("_k")
    jp = pct_change(F.col("cp1_win_rate"), F.col("cp2_win_rate"))
    rp = pct_change(F.col("cp1_rougeL"), F.col("cp2_rougeL"))
    bp = pct_change(F.col("cp1_bertscore"), F.col("cp2_bertscore"))
    j = (j.withColumn("judge_wr_abs_change", F.col("cp2_win_rate") - F.col("cp1_win_rate"))
          .withColumn("judge_wr_pct_change", jp)
          .withColumn("rougeL_pct_change", rp).withColumn("bertscore_pct_change", bp)
          .withColumn("has_catastrophic_forgetting", forgetting_flag(jp, rp, bp))
          .withColumn("forgetting_severity", severity(jp))
          .withColumn("severity_points", severity(100 * F.col("judge_wr_abs_change"),
                                                  SEVERITY_POINTS)))
    return findings_text(j, by_category)


def findings_text(s: DataFrame, by_category: DataFrame | None = None) -> DataFrame:
    """The findings as an ``array<string>`` column ``summary``: the
    verdict by severity, the automatic metrics, a line per category in name
    order, and the conclusion."""
    sev, pct = F.col("forgetting_severity"), F.col("judge_wr_pct_change")
    before, after = 100 * F.col("cp1_win_rate"), 100 * F.col("cp2_win_rate")
    move = F.format_string("%.2f%% → %.2f%%.", before, after)
    head = F.lit(HEADS["none"])
    line = F.when(pct > 0, F.concat(F.format_string("  Judge win rate improved by %.1f%%: ", pct), move)) \
            .otherwise(F.format_string("  Judge win rate stable: %.2f%% (minimal change).", before))
    for level in ("mild", "moderate", "severe"):
        head = F.when(sev == level, F.concat(F.lit(HEADS[level]), F.format_string(
            " (win rate drop %.1f%%).", pct))).otherwise(head)
        line = F.when(sev == level, F.concat(F.lit(DECLINES[level]), move)).otherwise(line)
    metrics = [F.format_string(f"  - {name}: %.3f → %.3f (change: %+.1f%%)", F.col(f"cp1_{m}"), F.col(f"cp2_{m}"),
                               F.col(f"{m}_pct_change"))
               for name, m in (("ROUGE-L", "rougeL"), ("BERTScore", "bertscore"))]
    end = F.when(sev == "none", F.lit(CONCLUSION_NONE)).otherwise(
        F.concat(F.lit(CONCLUSION_START), sev, F.lit(CONCLUSION_END)))
    none = F.array().cast("array<string>")
    if by_category is None:
        s = s.withColumn("_cats", none)
    else:
        text = F.concat(F.lit("  - "), F.col("category"), F.lit(": "),
                        F.when(F.col("percent_change") < 0, "↓").otherwise("↑"),
                        F.format_string(" %+.1f%% (%.2f%% → %.2f%%)", "percent_change",
                                        100 * F.col("cp1_win_rate"), 100 * F.col("cp2_win_rate")))
        lines = by_category.select("category", text.alias("t")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("category", "t"))), lambda x: x["t"]).alias("_cats"))
        s = s.withColumn("_k", F.lit(1)).join(lines.withColumn("_k", F.lit(1)), "_k").drop("_k")
    cats = F.when(F.size("_cats") > 0, F.concat(F.array(F.lit(""), F.lit("  Per-category impact:")), "_cats")) \
            .otherwise(none)
    return s.withColumn("summary", F.concat(
        F.array(head, line, F.lit(""), F.lit("  Automatic metrics:"), *metrics), cats,
        F.array(F.lit(""), end))).drop("_cats")


def aligned_changes(v: DataFrame, cats: DataFrame | None = None, first="cp1_vs_cp0",
                    second="cp2_vs_cp0") -> DataFrame:
    """E4 + H11 + J4: per prompt with valid verdicts in both comparisons, the
    challenger's mean raw score in each and the change, with a direction
    (regressed < -0.5 < maintained < 0.5 < improved, strict)."""
    def side(c, p):
        s = v.where(F.col("comparison") == c).select(
            "prompt_id", F.col("error").alias(p + "_error"), F.col("winner").alias(p + "_winner"),
            row_mean(F.col("raw_scores_a")).alias(p + "_score"))
        return s
    j = side(first, "cp1").join(side(second, "cp2"), "prompt_id")
    ok = F.col("cp1_error").isNull() & F.col("cp2_error").isNull()
    j = j.withColumn("change", F.col("cp2_score") - F.col("cp1_score")) \
         .withColumn("direction", F.when(~ok, F.lit(None))
                     .when(F.col("change") < -CHANGE_BAND, "regressed")
                     .when(F.col("change") > CHANGE_BAND, "improved").otherwise("maintained"))
    if cats is not None:
        j = j.join(cats, "prompt_id", "left").withColumn(
            "category", F.coalesce(F.col("category"), F.lit("unknown")))
    return j.drop("cp1_error", "cp2_error")


def top_examples(changes: DataFrame, k: int = 5) -> DataFrame:
    """J5 (D10 + D11): k largest regressions (ascending change) and k largest
    improvements (descending change), ties by prompt id."""
    d = changes.withColumn("_key", F.when(F.col("direction") == "improved", -F.col("change"))
                           .otherwise(F.col("change")))
    d = d.withColumn("_dir", F.when(F.col("direction").isin("regressed", "improved"),
                                    F.col("direction")))
    t = top_k(d, ["_dir"], ["_key", "prompt_id"], k, rank_col="rank")
    return t.where(F.col("_dir").isNotNull()).drop("_key", "_dir")


def example_buckets(changes: DataFrame) -> DataFrame:
    """First example (by prompt id) per maintained/improved/regressed bucket,
    with the bucket's size."""
    c = changes.withColumn("_b", F.col("direction"))
    sizes = c.groupBy("_b").agg(F.count(F.lit(1)).alias("bucket_size"))
    first = top_k(c, ["_b"], ["prompt_id"], 1)
    return (first.join(sizes, "_b").where(F.col("_b").isNotNull())
                 .select(F.col("_b").alias("bucket"), "prompt_id", "change", "bucket_size"))


def retention_gate(comparison: DataFrame, metrics=OPEN_METRICS,
                   max_drop_pct: float = 5.0) -> DataFrame:
    """Per stage-1 metric, pass unless the percent change drops by more
    than ``max_drop_pct``; plus the reason."""
    c = comparison.where(F.col("metric").isin(*metrics))
    passed = F.col("percent_change") >= -max_drop_pct
    return c.select("checkpoint_1", "checkpoint_2", "metric", "percent_change",
                    passed.alias("passed"),
                    F.when(passed, F.lit("ok")).otherwise(F.format_string(
                        "%s dropped %.2f%% (limit %.1f%%)", F.col("metric"),
                        -F.col("percent_change"), F.lit(max_drop_pct))).alias("reason"))
