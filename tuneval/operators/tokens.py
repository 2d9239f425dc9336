"""Tokenised training batches, data side only (K1-K5).

Re-aimed: tokens are Unicode-whitespace words (a BPE codec is per-row model
code, not a table operator). Left padding and the pad/EOS token follow the
tokenizer configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import words

# Pad token and padding side of the tokenizer configuration.
PAD_TOKEN = "<|endoftext|>"
MAX_LENGTH = 512


def encode(df: DataFrame, text: str, max_length: int = MAX_LENGTH, pad: bool = True,
           keep: str = "head") -> DataFrame:
    """K1 (+K2 with ``keep='tail'``, K3): tokens truncated to ``max_length``,
    left-padded, with attention mask and labels (a copy of the inputs)."""
    t = words(text)
    n = F.size(t)
    if keep == "head":
        kept = F.slice(t, 1, max_length)
    else:
        kept = F.when(n > 0, F.slice(t, F.greatest(n - max_length + 1, F.lit(1)), max_length)) \
                .otherwise(t)
    d = df.withColumn("n_tokens", n).withColumn("_kept", kept)
    k = F.size("_kept")
    npad = F.greatest(F.lit(max_length) - k, F.lit(0)) if pad else F.lit(0)
    d = d.withColumn("_npad", npad)
    ids = F.concat(F.array_repeat(F.lit(PAD_TOKEN), F.col("_npad")), F.col("_kept"))
    mask = F.concat(F.array_repeat(F.lit(0), F.col("_npad")), F.array_repeat(F.lit(1), k))
    return (d.withColumn("input_tokens", ids).withColumn("attention_mask", mask)
             .withColumn("labels", F.col("input_tokens")).drop("_kept", "_npad"))


def length_budget(df: DataFrame, n_tokens: str = "n_tokens", max_length: int = MAX_LENGTH,
                  by=()) -> DataFrame:
    """K4: rows over the budget, tokens dropped, mean/max and approximate
    median length (mergeable sketch, no single-task sort)."""
    n = F.col(n_tokens)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(n > max_length, 1)).alias("rows_over"),
        F.sum(F.greatest(n - max_length, F.lit(0))).alias("tokens_dropped"),
        F.round(F.avg(n), 6).alias("mean_tokens"), F.max(n).alias("max_tokens"),
        F.percentile_approx(n, 0.5, 10000).alias("p50_tokens"))


def step_plan(rows: Column, batch: int, accum: int, epochs) -> Column:
    """K5: optimizer steps = ceil(rows / (batch*accum)) * epochs."""
    return (F.ceil(rows / F.lit(batch * accum)) * epochs).cast("bigint")
