"""Exact ranks and positions without single-task windows.

``row_number() over (partition by g order by k)`` sends a whole group to one
task; with a group holding a third of the rows that task is the job. Here a
global range-partitioned sort splits hot groups across tasks and ranks come
from per-partition offsets:

* ``orderBy`` range-partitions on the full (unique) key, so any group may
  span many partitions;
* ``monotonically_increasing_id`` = (partition << 33) + row-in-partition;
* per-partition counts (one row per partition: a proven size bound) are
  turned into offsets and broadcast;
* the sorted frame is checkpointed to the shared checkpoint folder so the
  ids stay fixed even if an executor is lost and a stage is recomputed.

Where only the first rows of a group are wanted, ``with_smallest`` finds the
limit by counting and sorts nothing. Small fixed ``k`` top-k stays a window: Spark plans it as a partial
WindowGroupLimit before the shuffle, so each map task ships at most k rows
per group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint_dir, scratch_table

_LOW33 = (1 << 33) - 1


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def positions(df: DataFrame, order_cols, pos_col: str = "pos") -> DataFrame:
    """Exact 1-based global position in ``order_cols`` order (ties must be
    broken by the caller: the order key should be unique)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    s = (df.orderBy(*_cols(order_cols))
           .withColumn("_mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    part = s.select(F.shiftright(F.col("_mid"), 33).alias("_pid"))
    counts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))
                         .alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = (s.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
            .join(F.broadcast(offs), "_pid")
            .withColumn(pos_col, F.col("_off") + (F.col("_mid").bitwiseAND(F.lit(_LOW33))) + 1)
            .drop("_pid", "_off", "_mid"))
    return out


def rank_within(df: DataFrame, by, order_cols, rank_col: str = "rank",
                count_col: str | None = None) -> DataFrame:
    """Exact row_number within ``by`` groups, hot groups split across tasks.

    Optionally also attaches the group size as ``count_col``.
    """
    by = list(by)
    p = positions(df, [*by, *order_cols], "_gpos")
    aggs = [F.min("_gpos").alias("_first")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    if not by:
        # one aggregate row, joined on a constant key (broadcast hash join)
        p = p.withColumn("_all", F.lit(1))
        first = p.groupBy("_all").agg(*aggs)
        out = p.join(F.broadcast(first), "_all").drop("_all")
    else:
        # a row per group, whose size the planner knows
        first = scratch_table(p.groupBy(*by).agg(*aggs), "rank-groups")
        out = p.join(first, by)
    return out.withColumn(rank_col, F.col("_gpos") - F.col("_first") + 1).drop("_gpos", "_first")


def top_k(df: DataFrame, by, order_cols, k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per group (``row_number() <= k``, WindowGroupLimit)."""
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order_cols))
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def first_fraction(df: DataFrame, by, order_cols, frac: float, min_one: bool = False,
                   rank_col: str = "rank") -> DataFrame:
    """First ``int(n*frac)`` rows per group (``max(1, ...)`` if ``min_one``)."""
    r = rank_within(df, by, order_cols, rank_col, count_col="_n")
    k = F.floor(F.col("_n") * F.lit(float(frac)))
    if min_one:
        k = F.greatest(k, F.lit(1))
    return r.where(F.col(rank_col) <= k).drop("_n")


def _on_group(rows: DataFrame, state: DataFrame, group, how: str = "inner") -> DataFrame:
    """Join one row per group; null is a group like any other."""
    s = state.select(*[F.col(g).alias(g + "_s") if g in group else F.col(g) for g in state.columns])
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(g + "_s")) for g in group])
    return rows.join(s, same, how).drop(*[g + "_s" for g in group])


def _digits(c: str, bits: int, integral: bool) -> list:
    """A column in order as numbers of 16 bits, the most significant first."""
    x = F.col(c).cast("long") if integral else F.xxhash64(c)
    if bits == 64:
        x = x.bitwiseXOR(F.lit(-(1 << 63)))     # signed order as unsigned order
    return [F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0xFFFF)) for s in range(bits - 16, -1, -16)]


def with_smallest(df: DataFrame, key: str, k, by=(), ties=(), bits: int = 64,
                  flag: str = "in_k") -> DataFrame:
    """``df`` with a flag: is the row among the ``k(n)`` smallest of its group
    of ``n`` rows, ordered by ``key`` (long) and then by ``ties``?

    ``k`` maps the group's size (a Column) to the number of rows. The limit
    of every group is found 16 bits at a time: each pass counts the rows that
    share the settled bits by their next ones, at most 65,536 counts per
    group, until the settled bits alone tell who is in. So nothing is sorted
    and only the keys are written (once, to the shared folder); the rows
    themselves are compared where they are with one row per group, which the
    planner broadcasts if the groups' number allows. ``bits`` = 32 is for
    keys in [0, 2^32). Ties that are no integers are ordered by a hash. Rows
    that are equal in all of it are in or out together.
    """
    by, ties = list(by), list(ties)
    whole = {f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "short", "byte")}
    digits = _digits(key, bits, True) + [d for t in ties for d in _digits(t, 64, t in whole)]
    group = [f"_by{i}" for i in range(len(by))] + ["_all"]
    named = [F.col(c).alias(g) for c, g in zip(by, group)] + [F.lit(0).alias("_all")]
    keys = scratch_table(df.select(*named, *[d.cast("int").alias(f"_d{i}") for i, d in enumerate(digits)]),
                         "rank-keys")
    in_order = Window.partitionBy(*group).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = None
    for i in range(len(digits)):
        settled = [f"_d{j}" for j in range(i)]
        rows = keys if state is None else _on_group(keys, state, [*group, *settled])
        kept = [] if state is None else ["_left"]
        hist = rows.groupBy(*group, *settled, *kept, F.col(f"_d{i}").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        if state is None:
            n = F.sum("_c").over(Window.partitionBy(*group))
            hist = hist.withColumn("_left", F.least(n, k(n)).cast("long"))
        before = F.col("_cum") - F.col("_c")
        found = scratch_table(
            hist.withColumn("_cum", F.sum("_c").over(in_order))
                .where((F.col("_cum") >= F.col("_left")) & (before < F.col("_left")))
                .select(*group, *settled, F.col("_d").alias(f"_d{i}"), (F.col("_left") - before).alias("_left"), "_c"),
            "rank-state")
        state = found.drop("_c")
        if found.where("_c > _left").isEmpty():
            break
    limit = state.select(*group, F.array(*[c for c in state.columns if c.startswith("_d")]).alias("_limit"))
    own = F.array(*[d.cast("int") for d in digits[:i + 1]])
    j = _on_group(df.select("*", *named, own.alias("_own")), limit, group, "left")
    return j.withColumn(flag, F.coalesce(F.col("_own") <= F.col("_limit"), F.lit(False))).select(*df.columns, flag)


def lead_within(df: DataFrame, by, order_col: str, cols, suffix: str = "_next",
                bucket: int = 4096) -> DataFrame:
    """Exact ``lead(col) over (partition by by order by order_col)`` for a
    numeric, unique-within-group ``order_col``, without a per-group window.

    Rows are windowed per (group, ``order_col // bucket``), so a hot group is
    split into buckets of at most ``bucket`` consecutive key values. The
    last row of a bucket takes the first row of the next non-empty bucket:
    one row per bucket (a partial ``min_by`` aggregate), ordered by a window
    over buckets, joined back on (group, bucket) — a key a hot group cannot
    skew.
    """
    by = list(by)
    o = F.col(order_col)
    d = df.withColumn("_b", F.floor(o / F.lit(bucket)).cast("long"))
    w = Window.partitionBy(*by, "_b").orderBy(order_col)
    d = d.withColumns({"_last": F.lead(o).over(w).isNull(),
                       **{c + "_in": F.lead(c).over(w) for c in cols}})
    firsts = (df.withColumn("_b", F.floor(o / F.lit(bucket)).cast("long"))
                .groupBy(*by, "_b").agg(F.min_by(F.struct(*cols), o).alias("_f")))
    nxt = firsts.withColumn("_nf", F.lead("_f").over(Window.partitionBy(*by).orderBy("_b"))) \
                .select(*by, "_b", "_nf")
    j = d.join(nxt, [*by, "_b"], "left")
    j = j.withColumns({c + suffix: F.when(F.col("_last"), F.col("_nf")[c])
                       .otherwise(F.col(c + "_in")) for c in cols})
    return j.drop("_b", "_last", "_nf", *[c + "_in" for c in cols])
