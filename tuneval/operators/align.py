"""Joins, alignment and reshaping.

Rows are matched by explicit ids, never by position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schemas import COMPARISONS

CHECKPOINTS = ("cp0", "cp1", "cp2")


def eval_with_outputs(eval_df: DataFrame, resp: DataFrame, keys=("suite", "prompt_id"),
                      response="response") -> DataFrame:
    """Eval ⟕ responses, '' for absent responses."""
    return eval_df.join(resp.select(*keys, response), list(keys), "left") \
                  .withColumn(response, F.coalesce(F.col(response), F.lit("")))


def pair_zip(resp: DataFrame, cp_a: str, cp_b: str, key="prompt_id",
             response="response") -> DataFrame:
    """Responses of two checkpoints side by side (inner join on the id)."""
    a = resp.where(F.col("checkpoint") == cp_a).select(key, F.col(response).alias("response_a"))
    b = resp.where(F.col("checkpoint") == cp_b).select(key, F.col(response).alias("response_b"))
    return a.join(b, key)


def comparison_table(spark) -> DataFrame:
    """The comparison dimension (comparison, challenger, opponent)."""
    return spark.createDataFrame(list(COMPARISONS), "comparison string, challenger string, "
                                 "opponent string")


def comparison_pairs(resp: DataFrame, comparisons: DataFrame, key="prompt_id",
                     response="response") -> DataFrame:
    """For each comparison, challenger and opponent responses per prompt.

    The planner broadcasts the comparison table if its size allows; responses are
    self-joined on (prompt id, checkpoint), so the join key is never a
    checkpoint alone.
    """
    c = comparisons
    a = resp.select(key, F.col("checkpoint").alias("challenger"),
                    F.col(response).alias("response_a"))
    b = resp.select(key, F.col("checkpoint").alias("opponent"),
                    F.col(response).alias("response_b"))
    return a.join(c, "challenger").join(b, [key, "opponent"])


def to_wide(resp: DataFrame, keys=("suite", "prompt_id"), checkpoints=CHECKPOINTS,
            response="response") -> DataFrame:
    """E5: one column per checkpoint (explicit pivot values, NULL if absent; of
    several responses under one id the greatest)."""
    return resp.groupBy(*keys).pivot("checkpoint", list(checkpoints)).agg(F.max(response))


def to_long(wide: DataFrame, keys=("suite", "prompt_id"), checkpoints=CHECKPOINTS,
            response="response") -> DataFrame:
    """Wide -> long (absent checkpoints dropped)."""
    return (wide.unpivot(list(keys), list(checkpoints), "checkpoint", response)
                .where(F.col(response).isNotNull()))


def phase_fallback(wide: DataFrame, primary="cp2", fallback="cp1", out="response") -> DataFrame:
    """Phase-2 response, else phase-1."""
    return wide.withColumn(out, F.coalesce(F.col(primary), F.col(fallback)))


def concat_suites(*dfs: DataFrame) -> DataFrame:
    """suite/corpus concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
