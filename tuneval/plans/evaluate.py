"""Composed evaluation jobs (I6, I8, I9, I10) built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.text import word_count
from ..operators import align, forgetting, jsonq, normalize, sampling, textsim
from ..operators import verdicts as V
from ..session import checkpoint_dir
from ..sources import files


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir``.

    Used after parsing: it cuts lineage (executor loss recomputes from the
    written files) and stops filters downstream from being pushed into the
    parse expressions, which Catalyst would otherwise inline per branch.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def category_win_rates(v: DataFrame, cats: DataFrame, first="cp1_vs_cp0",
                       second="cp2_vs_cp0") -> DataFrame:
    """Per category, challenger win rate in two comparisons and the change.

    Totals count every verdict row of the category (errors have no winner);
    prompts without a category are dropped from the tallies (inner join, E3).
    """
    j = v.join(cats, "prompt_id")
    c1, c2 = F.col("comparison") == first, F.col("comparison") == second
    t1, t2 = F.count(F.when(c1, 1)), F.count(F.when(c2, 1))
    w1 = F.count(F.when(c1 & (F.col("winner") == "A"), 1))
    w2 = F.count(F.when(c2 & (F.col("winner") == "A"), 1))
    g = j.groupBy("category").agg(F.coalesce(w1 / F.nullif(t1, F.lit(0)), F.lit(0.0)).alias("r1"),
                                  F.coalesce(w2 / F.nullif(t2, F.lit(0)), F.lit(0.0)).alias("r2"),
                                  t1.alias("total_examples"))
    return g.select("category", F.round("r1", 6).alias("cp1_win_rate"),
                    F.round("r2", 6).alias("cp2_win_rate"),
                    F.round(F.col("r2") - F.col("r1"), 6).alias("absolute_change"),
                    F.round(F.when(F.col("r1") > 0, (F.col("r2") - F.col("r1")) / F.col("r1") * 100)
                            .otherwise(F.lit(0.0)), 6).alias("percent_change"),
                    "total_examples")


def pairwise_eval(responses: DataFrame, raw_verdicts: DataFrame, comparisons: DataFrame | None = None,
                  sample_size: int | None = None, seed: str = "42") -> DataFrame:
    """Pair the checkpoints of every comparison (E8; by default all),
    optionally sample pairs of each (D5), attach the judge replies by
    (comparison, prompt id), parse/unswap them and aggregate (H6)."""
    if comparisons is None:
        comparisons = align.comparison_table(responses.sparkSession)
    pairs = align.comparison_pairs(responses.select("prompt_id", "checkpoint", "response"), comparisons)
    if sample_size:
        pairs = sampling.fixed_sample(pairs, sample_size, seed=seed, by=("comparison",))
    j = raw_verdicts.join(pairs.select("comparison", "prompt_id"), ["comparison", "prompt_id"], "left_semi")
    return V.win_rates(V.normalize_verdicts(V.parse_verdicts(j)))


def checkpoint_summary(json_metrics: DataFrame, open_metrics: DataFrame, win: DataFrame,
                       checkpoints=("cp0", "cp1", "cp2"), opponent: str = "cp0") -> DataFrame:
    """I8: one row per checkpoint, six metrics, missing = 0.

    The judge win rate of a checkpoint is its challenger share against
    ``opponent`` (the reference reads a key nothing writes, so it is always
    0 there; SURVEY §3.3 fixes the definition).
    """
    spark = json_metrics.sparkSession
    cps = spark.createDataFrame([(c,) for c in checkpoints], "checkpoint string")
    w = win.select(F.regexp_extract("comparison", r"^(.*)_vs_" + opponent + "$", 1)
                   .alias("checkpoint"), F.col("win_rate_a").alias("judge_win_rate")) \
           .where(F.col("checkpoint") != "")
    j = (cps.join(json_metrics.select("checkpoint", "validity_rate", "compliance_rate",
                                      "exact_match_rate"), "checkpoint", "left")
            .join(open_metrics.select("checkpoint", "rougeL", "bertscore_f1"), "checkpoint", "left")
            .join(w, "checkpoint", "left"))
    cols = ["validity_rate", "compliance_rate", "exact_match_rate", "rougeL", "bertscore_f1",
            "judge_win_rate"]
    return j.select("checkpoint", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
                                    for c in cols])


def open_rows(responses: DataFrame, token_vectors: DataFrame | None = None,
              keys=("prompt_id", "checkpoint"), stem: bool = False) -> DataFrame:
    """Per-row scores of the open-ended suite: words, completion, rouge1,
    rouge2, rougeL, bertscore_f1 (NULL without token vectors).

    ``responses(*keys, response, reference)``. Texts are tokenised (and
    stemmed) once; everything but the n-gram counts is carried along.
    """
    p = responses.select(*keys, "response", "reference")
    if token_vectors is not None:
        b = textsim.bertscore(token_vectors).select(*keys, F.col("bert_f1").alias("bertscore_f1"))
        p = p.join(b, list(keys), "left")
    else:
        p = p.withColumn("bertscore_f1", F.lit(None).cast("double"))
    p = textsim.rouge_l(p, "response", "reference", stem=stem, keep_tokens=True)
    p = p.withColumns({"words": word_count("response").cast("double"),
                       "completion": textsim.task_completion("response")})
    return textsim.rouge_n(p, keys, "response", "reference",
                           carry=("words", "completion", "rougeL", "bertscore_f1"))


def open_suite_metrics(rows: DataFrame, by=("checkpoint",)) -> DataFrame:
    """Count, mean words, ROUGE-1/2/L and BERTScore per checkpoint."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("words").alias("avg_response_length"),
        *[F.avg(m).alias(m) for m in ("rouge1", "rouge2", "rougeL", "bertscore_f1")])


def tidy_metrics(open_metrics: DataFrame, json_metrics: DataFrame) -> DataFrame:
    """(checkpoint, metric, value) of both suites."""
    return (open_metrics.unpivot("checkpoint", list(forgetting.OPEN_METRICS), "metric", "value")
            .unionByName(json_metrics.unpivot("checkpoint", list(forgetting.JSON_METRICS), "metric", "value")))


def evaluate(instruct: DataFrame, responses: DataFrame, json_items: DataFrame,
             raw_verdicts: DataFrame, token_vectors: DataFrame | None = None,
             categories: DataFrame | None = None, max_error_share: float | None = None) -> dict:
    """The full evaluation as named DataFrames.

    With ``max_error_share`` it is an error if more of a checkpoint's responses
    are errors (I11): the shares are observed while the responses are written
    for the reports, and no report exists before.

    Parsed verdicts and the metrics per checkpoint (a row each) are
    materialised once in the checkpoint folder and reused by every report;
    everything else stays a lazy plan for the caller to write
    (``write_reports``).
    """
    responses = guarded(responses, max_error_share)
    resp = responses.join(instruct.select("prompt_id", F.col("output").alias("reference")), "prompt_id")
    open_metrics = materialize(open_suite_metrics(open_rows(resp, token_vectors)))
    json_metrics = materialize(jsonq.suite_metrics(json_items))
    taxonomy = jsonq.error_taxonomy(json_items, form="detailed")
    v = materialize(V.normalize_verdicts(V.parse_verdicts(raw_verdicts)))
    win = materialize(V.win_rates(v))
    dims = V.dimension_averages(v)
    tidy = tidy_metrics(open_metrics, json_metrics)
    comparison = forgetting.compare_checkpoints(tidy, (("cp0", "cp1"), ("cp1", "cp2")))
    by_category = category_win_rates(v, categories) if categories is not None else None
    summary = forgetting.forgetting_summary(win, tidy, by_category)
    out = {"open_metrics": open_metrics, "json_metrics": json_metrics,
           "error_taxonomy": taxonomy, "win_rates": win, "dimension_averages": dims,
           "comparison": comparison, "forgetting": summary, "verdicts": v,
           "checkpoints": checkpoint_summary(json_metrics, open_metrics, win)}
    return out | ({"categories": by_category} if by_category is not None else {})


class TooManyErrors(ValueError):
    """A checkpoint whose responses are errors too often."""


def guarded(responses: DataFrame, max_error_share: float | None = None,
            checkpoints=align.CHECKPOINTS) -> DataFrame:
    """The responses, written once, unless errors among them exceed the
    share in a checkpoint; rows and errors are observed in the same pass."""
    if max_error_share is None:
        return responses
    seen, s = Observation(), normalize.response_status(responses)
    of = {c: F.col("checkpoint") == c for c in checkpoints}
    error = F.col("response_status") == "error"
    s = materialize(s.observe(seen, *[F.count_if(x).alias(f"n_{c}") for c, x in of.items()],
                              *[F.count_if(x & error).alias(f"e_{c}") for c, x in of.items()]))
    n = seen.get
    for c in checkpoints:
        if n[f"e_{c}"] > max_error_share * n[f"n_{c}"]:
            raise TooManyErrors(f"{c}: {n[f'e_{c}']} of {n[f'n_{c}']} responses are errors, "
                                f"more than {100 * max_error_share:g} %")
    return s.select(*responses.columns)


def write_reports(reports: dict, path: str, fmt: str = "parquet") -> dict:
    """A10: every report of ``evaluate`` as a table under ``path``; returns
    the paths by name. VARIANT columns (raw parsed verdicts) stay out."""
    out = {}
    for name, df in reports.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        files.write_table(df.drop(*[f.name for f in df.schema.fields if f.dataType.typeName() == "variant"]),
                          out[name], fmt=fmt)
    return out
