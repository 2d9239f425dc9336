"""Sampling, splitting, ordering and data audits.

All randomness is md5 hash order with an explicit seed, so Spark, DuckDB
and reruns agree and results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import seeded_order_key
from ..functions.text import WS_RUN, utrim
from .ranking import positions, top_k, with_smallest


def seeded_shuffle(df: DataFrame, seed="42", id_cols=("prompt_id",), pos_col="pos") -> DataFrame:
    """1-based position in seeded hash order.

    Only the ids are sorted and checkpointed; the rows meet their position by
    id, wherever they are (a broadcast if the ids are few). ``id_cols`` must
    identify a row; rows with a null id have no position.
    """
    keys = df.select(*id_cols).withColumn("_h", seeded_order_key(seed, *id_cols))
    return df.join(positions(keys, ["_h", *id_cols], pos_col).drop("_h"), list(id_cols), "left")


def holdout_split(df: DataFrame, k: int, seed="42", id_cols=("prompt_id",), by=()) -> DataFrame:
    """Exactly ``k`` rows (per group) to eval, the rest to train (``split``)."""
    d = df.withColumn("_h", seeded_order_key(seed, *id_cols))
    r = with_smallest(d, "_h", lambda n: F.lit(k), by, id_cols, bits=32, flag="_in")
    return r.withColumn("split", F.when(F.col("_in"), "eval").otherwise("train")).drop("_h", "_in")


def stride_split(df: DataFrame, pos_col="pos", stride: int = 2) -> DataFrame:
    """D3: every ``stride``-th row (1st, 3rd, ...) to eval, the rest to train."""
    return df.withColumn("split", F.when((F.col(pos_col) - 1) % stride == 0, "eval")
                         .otherwise("train"))


def fraction_sample(df: DataFrame, rate: float, seed="42", id_cols=("prompt_id",),
                    by=()) -> DataFrame:
    """``max(1, int(n*rate))`` rows per group without replacement."""
    if rate >= 1.0:
        return df
    d = df.withColumn("_h", seeded_order_key(seed, *id_cols))
    r = with_smallest(d, "_h", lambda n: F.greatest(F.floor(n * F.lit(float(rate))), F.lit(1)), by, id_cols,
                      bits=32, flag="_in")
    return r.where("_in").drop("_h", "_in")


def fixed_sample(df: DataFrame, k: int, seed="42", id_cols=("prompt_id",), by=()) -> DataFrame:
    """``k`` rows per group in hash order (all when the group is smaller).

    Without groups the limit is found by counting, whatever ``k``; per group a
    window keeps at most ``k`` rows of each task before the shuffle.
    """
    d = df.withColumn("_h", seeded_order_key(seed, *id_cols))
    if not by:
        return with_smallest(d, "_h", lambda n: F.lit(k), (), id_cols, bits=32, flag="_in").where("_in").drop("_h", "_in")
    return top_k(d, list(by), ["_h", *id_cols], k).drop("_h")


def swap_flag(*parts, seed="swap") -> F.Column:
    """Reproducible fair coin per row."""
    return (seeded_order_key(seed, *parts) % 2).cast("int")


def text_key(*cols) -> F.Column:
    """Normalised content key: md5 of lower-cased, whitespace-collapsed text."""
    norm = [F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), WS_RUN, " ")
            for c in cols]
    return F.md5(F.concat_ws("\u0001", *[utrim(n) for n in norm]))


def contamination(eval_df: DataFrame, train_df: DataFrame, cols=("instruction", "input")) -> DataFrame:
    """The evaluation rows with a flag ``in_train`` (equal by content key).

    One left join on a 128-bit content hash; only the distinct keys of the
    train side are shuffled.
    """
    t = train_df.select(text_key(*cols).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return (eval_df.withColumn("_key", text_key(*cols)).join(t, "_key", "left")
                   .withColumn("in_train", F.col("_hit").isNotNull()).drop("_key", "_hit"))


def duplicate_groups(df: DataFrame, cols=("instruction", "input")) -> DataFrame:
    """Groups of identical content with their size (> 1 only)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
              .where(F.col("copies") > 1))
