"""Mixing sources to target weights (native DataFrame operations only).

Words are summed per source, weights share a wanted total, and every
document is taken floor(rate) times plus one Bernoulli copy, where the rate
is the source's target over its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import positions
from .common import WORD, checkpoint, written

SEED = 42
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2


def word_count(text) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(seed: int, id_col, text_col) -> Column:
    """A document's uniform number in [0, 1): 52 bits of an MD5 of seed, id
    and text, which any SQL engine computes alike."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                      F.coalesce(F.md5(F.col(text_col)), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order (null last) take the weights in turn. The
    weighted shares of ``share`` x all sizes stop at ``max_repeat`` x the
    source's size; the excess is shared again by weight among the rest until
    no target is above its limit. Each round is one aggregate over the table
    of sources; only its three sums reach the driver. A source of size 0 has
    target 0. No sources: no rows.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = positions(sizes, [F.col("source").asc_nulls_last()])
    src = checkpoint(ranked.select("source", "source_size", w.alias("w"),
                                   (F.col("source_size") * max_repeat).alias("limit")))
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None  # target per unit of weight; a source is full if its limit is below
    while True:
        full = F.lit(False) if level is None else F.col("limit") < F.col("w") * F.lit(level)
        n, used, rest = src.agg(F.count_if(full),
                                F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)),
                                F.sum(F.when(~full, F.col("w")))).first()
        if not rest:
            break
        new = (share * total - used) / rest
        if level is not None and new <= level:
            break
        level = new
    if level is None:
        return src.select("source", "source_size", F.lit(0.0).alias("target"))
    return src.select("source", "source_size",
                      F.least(F.col("limit").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """Every input column followed by size, source_size, target, copies, taken.

    ``copies`` = floor(rate) + [coin(seed, id, text) < fraction of the rate],
    ``taken`` = copies x size. The hash decides alike in every run. Repeated
    rows decide alike. Null text: size 0, and so does an empty one; null
    source: a source of its own, last in order. Input columns that carry one
    of the five names are replaced. Source sizes are summed before the
    shuffle, so a hot source costs no more than a small one.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    clash = {*made, "__source"}
    keep = [c for c in docs.columns if c.lower() not in clash or c in (id_col, text_col, source_col)]
    d = docs.select(*[F.col(c) for c in keep],
                    F.col(source_col).alias("__source"),
                    word_count(F.col(text_col)).alias("__size"))
    sizes = (d.groupBy(F.col("__source").alias("source"))
              .agg(F.sum("__size").alias("source_size")))
    # written as a table, so that its size tells the planner whether to broadcast it
    t = written(source_targets(sizes, **targets).select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target")), "mix-targets")
    j = d.join(t, F.col("__source").eqNullSafe(F.col("__s")), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    j = j.withColumn("__rate", rate)
    extra = coin(seed, id_col, text_col) < F.col("__rate") - F.floor("__rate")
    copies = (F.floor("__rate") + extra.cast("long")).cast("long")
    out = [c for c in keep if c.lower() not in made]
    return (j.withColumn("__copies", copies)
             .select(*out, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                     F.col("__target").alias("target"), F.col("__copies").alias("copies"),
                     (F.col("__copies") * F.col("__size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """The mixed corpus: each document ``copies`` times, input columns only."""
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                         F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.col(source_col).alias("source"))
    plan = mix_plan(packed, seed=seed, **targets)
    return (plan.where(F.col("copies") > 0)
                .select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"))
                .select(*cols))
