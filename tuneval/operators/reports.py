"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def r6(c) -> F.Column:
    return F.round(c, 6)


def status_rates(df: DataFrame, by=("checkpoint",), status="response_status") -> DataFrame:
    """Share of each response status per group.

    Counts are a partial aggregate; shares divide by the group total, which is
    a window over the (tiny) aggregated table only.
    """
    c = df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*by))
    return c.withColumn("share", r6(F.col("n") / tot))


def status_guard(rates: DataFrame, max_error_share: float = 0.5,
                 status="response_status") -> DataFrame:
    """I11 guard: checkpoints whose error share exceeds the threshold."""
    return (rates.where((F.col(status) == "error") & (F.col("share") > max_error_share))
                 .select("checkpoint", F.col("share").alias("error_share")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
