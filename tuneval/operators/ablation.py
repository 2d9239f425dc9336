"""Ablation grid, results and report."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .forgetting import severity

# The ablation grid (types, variants, stage-2 settings).
EPOCHS = (1, 2, 3)
LEARNING_RATES = (2e-5, 1e-5, 5e-6)
DATASET_PCTS = (100, 50, 25)
APPROACHES = ("sequential", "combined")
DEFAULT_LR = 2e-5
DEFAULT_EPOCHS = 2

CONFIG_SCHEMA = ("ablation_type string, variant_name string, stage2_epochs int, "
                 "stage2_learning_rate double, stage2_dataset_size_pct double, "
                 "training_approach string, description string")


def config_rows():
    rows = [("epochs", f"epochs_{e}", e, DEFAULT_LR, 100.0, "sequential",
             f"Stage 2 with {e} epoch(s)") for e in EPOCHS]
    rows += [("learning_rate", f"lr_{lr:.0e}", DEFAULT_EPOCHS, lr, 100.0, "sequential",
              f"Stage 2 with learning rate {lr}") for lr in LEARNING_RATES]
    rows += [("dataset_size", f"datasize_{p}pct", DEFAULT_EPOCHS, DEFAULT_LR, float(p),
              "sequential", f"Stage 2 with {p}% of the data") for p in DATASET_PCTS]
    rows += [("sequential_vs_combined", a, None, None, 100.0, a, f"{a} training")
             for a in APPROACHES]
    return rows


def config_grid(spark: SparkSession) -> DataFrame:
    """The 11 ablation configurations."""
    return spark.createDataFrame(config_rows(), CONFIG_SCHEMA)


def _committed(path: str) -> str:
    return path.rstrip("/") + "_committed"


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt) of the runs in a result log, an attempt each."""
    try:
        log = spark.read.schema("run_id string, attempt string, at timestamp").parquet(_committed(path))
    except AnalysisException:       # no run was ever committed
        return spark.createDataFrame([], "run_id string, attempt string")
    return log.groupBy("run_id").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def append_results(results: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append a run's results with a timestamp.

    An attempt writes a folder of its own, then commits it with one row beside
    the log. A run that is there already is not written again (False), so a job
    may be repeated; what an attempt left that was stopped, or that came second,
    no reader sees. Without ``run_id`` the results are a run of their own.
    """
    spark = results.sparkSession
    run_id, attempt = run_id or uuid.uuid4().hex, uuid.uuid4().hex
    if not committed_runs(spark, path).where(F.col("run_id") == run_id).isEmpty():
        return False
    results.withColumn("timestamp", F.current_timestamp()).write.parquet(
        f"{path.rstrip('/')}/run_id={quote(run_id, safe='')}/attempt={attempt}")
    (spark.range(1).coalesce(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"),
                                       F.current_timestamp().alias("at"))
     .write.mode("append").parquet(_committed(path)))
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of the committed runs, each run once."""
    runs = committed_runs(spark, path)
    return (spark.read.option("basePath", path).parquet(path)
            .withColumns({c: F.col(c).cast("string") for c in ("run_id", "attempt")})
            .join(runs, ["run_id", "attempt"], "left_semi").drop("attempt"))


def _fmt_pct(c):
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", c * 100))


def report(results: DataFrame) -> DataFrame:
    """One line per variant, grouped by type and ordered by variant name;
    NULL metrics shown as N/A."""
    return results.select(
        "ablation_type", "variant_name",
        _fmt_pct(F.col("json_exact_match_rate")).alias("json_acc"),
        _fmt_pct(F.col("alpaca_judge_win_rate")).alias("alpaca_wr"),
        F.coalesce(F.col("forgetting_severity"), F.lit("N/A")).alias("forgetting"),
        F.when(F.col("primary_metric").isNull(), F.lit("N/A"))
         .otherwise(F.format_string("%.3f", F.col("primary_metric"))).alias("primary")
    ).orderBy("ablation_type", "variant_name")


def epoch_trend(results: DataFrame) -> DataFrame:
    """Last minus first primary metric over epochs (missing epochs sort
    as 0; 0 is treated as a value, unlike the reference's truthiness test)."""
    e = results.where(F.col("ablation_type") == "epochs")
    return e.agg(F.min_by("primary_metric", F.coalesce("stage2_epochs", F.lit(0))).alias("first"),
                 F.max_by("primary_metric", F.coalesce("stage2_epochs", F.lit(0))).alias("last")) \
            .select(F.round(F.col("last") - F.col("first"), 6).alias("trend"))


def best_variant(results: DataFrame, ablation_type="learning_rate") -> DataFrame:
    """Arg-max of the primary metric (NULL ignored)."""
    r = results.where((F.col("ablation_type") == ablation_type) &
                      F.col("primary_metric").isNotNull())
    return r.agg(F.max_by("variant_name", F.struct("primary_metric", "variant_name"))
                 .alias("best_variant"),
                 F.max("primary_metric").alias("best_primary"))


def size_effect(results: DataFrame) -> DataFrame:
    """Adjacent dataset sizes (largest first) with their exact-match
    rates, labelled with the sizes actually compared."""
    s = results.where(F.col("ablation_type") == "dataset_size")
    w = Window.partitionBy("ablation_type").orderBy(F.desc("stage2_dataset_size_pct"))
    return (s.withColumn("from_pct", F.lag("stage2_dataset_size_pct").over(w))
             .withColumn("from_rate", F.lag("json_exact_match_rate").over(w))
             .where(F.col("from_pct").isNotNull())
             .select("from_pct", F.col("stage2_dataset_size_pct").alias("to_pct"),
                     F.round("from_rate", 6).alias("from_rate"),
                     F.round("json_exact_match_rate", 6).alias("to_rate")))


def approach_comparison(results: DataFrame) -> DataFrame:
    """Forgetting severity of sequential vs combined training."""
    r = results.where(F.col("ablation_type") == "sequential_vs_combined")
    return r.agg(F.max(F.when(F.col("training_approach") == "sequential",
                              F.col("forgetting_severity"))).alias("sequential_forgetting"),
                 F.max(F.when(F.col("training_approach") == "combined",
                              F.col("forgetting_severity"))).alias("combined_forgetting"))


def loss_curve(meta: DataFrame) -> DataFrame:
    """Per-epoch loss delta and the epoch count with the lowest loss.

    ``meta(epochs, training_loss)`` is one row per run (small by nature;
    the window has a single partition of a handful of runs)."""
    w = Window.orderBy("epochs")
    d = meta.select("epochs", "training_loss",
                    (F.col("training_loss") - F.lag("training_loss").over(w)).alias("loss_delta"))
    best = meta.agg(F.min_by("epochs", "training_loss").alias("best_epochs"))
    return d.withColumn("_k", F.lit(1)).join(F.broadcast(best.withColumn("_k", F.lit(1))), "_k") \
            .drop("_k")


def results_from_flags(flags: DataFrame, configs: DataFrame, base_flags: DataFrame,
                       win: DataFrame | None = None) -> DataFrame:
    """Ablation results from per-item JSON flags of each variant.

    ``flags(variant_name, valid, schema, exact)`` are a variant's scored
    responses; ``base_flags(variant_name, exact)`` the baseline's on the same
    items; ``win(variant_name, win_rate)`` the judge's win rate of a variant
    where one was measured. Rates are means; the primary metric is the
    exact-match rate and the forgetting severity applies J3 to its percent
    change over baseline.
    """
    m = flags.groupBy("variant_name").agg(
        F.avg("valid").alias("json_validity_rate"), F.avg("schema").alias("json_compliance_rate"),
        F.avg("exact").alias("json_exact_match_rate"))
    b = base_flags.groupBy("variant_name").agg(F.avg("exact").alias("_base"))
    r = configs.join(m, "variant_name", "left").join(b, "variant_name", "left")
    if win is None:
        r = r.withColumn("alpaca_judge_win_rate", F.lit(None).cast("double"))
    else:
        r = r.join(win.select("variant_name", F.col("win_rate").alias("alpaca_judge_win_rate")),
                   "variant_name", "left")
    chg = F.when(F.col("_base") > 0, (F.col("json_exact_match_rate") - F.col("_base")) /
                 F.col("_base") * 100).otherwise(F.lit(0.0))
    return (r.withColumn("primary_metric", F.col("json_exact_match_rate"))
             .withColumn("forgetting_severity", F.when(F.col("_base").isNotNull(), severity(chg)))
             .drop("_base"))
