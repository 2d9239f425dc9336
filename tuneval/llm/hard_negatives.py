"""Hard negatives by shared lists of anchor clusters.

Vectors become whole numbers, so scores are exact integers. Anchors are a
stated query set; they are dealt into blocks of bounded size, and every block
meets all rows twice: once for each anchor's positives, once, with these
known, for the negatives of every (anchor, positive). Within a task, for a
slice of rows and each cluster of anchors:

* the rows are sorted once by an upper bound on their score. With t the angle
  between row v and the cluster's centre and b the widest angle of a member,
  no member u scores more than |u| |v| cos(max(0, t - b));
* all members walk that list in steps. A member leaves it when the bound of
  what is left lies below the last score it still needs, which certifies that
  nothing better follows.

A task keeps the few best rows of every anchor; Spark ranks what tasks kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import discard, record_batch, scratch_path

BLOCK_BYTES = 16 << 20      # vectors of a block of anchors
SLICE_ROWS = 16_384         # rows whose lists are sorted at once
STEP = 512                  # rows walked at a time
ROUNDS = 8                  # of clustering
SLACK = 1e-5                # radians that rounding may cost a bound

EXACT = 1 << 52             # float64 products of smaller norms are exact
NONE, LAST = 1 - (1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str,
                  scale: int) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part, with v = floor(scale * x)."""
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("v"),
                      F.coalesce(anchor, F.lit(False)).alias("anchor")).where(
        "id is not null and label is not null and v is not null")
    schema = src.schema

    def run(batches):
        for b in batches:
            v = b.column(2)
            x = v.flatten().to_numpy(zero_copy_only=False)       # null components arrive as NaN
            n = pc.list_value_length(v).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            good = np.bincount(row[~np.isfinite(x)], minlength=len(n)) == 0
            whole = pa.ListArray.from_arrays(np.cumsum(np.r_[0, n], dtype=np.int32), np.floor(scale * x))
            yield record_batch(schema, {"id": b.column(0), "label": b.column(1), "v": whole,
                                        "anchor": b.column(3)}).filter(pa.array(good))

    return src.mapInArrow(run, schema)


def by_length(vectors: pa.ListArray):
    """(places, matrix) of the vectors of each length."""
    n = pc.list_value_length(vectors).to_numpy()
    x = vectors.flatten().to_numpy()
    ends = np.cumsum(n)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield at, x[(ends[at] - d)[:, None] + np.arange(d)].reshape(len(at), d)


def directions(x: np.ndarray) -> tuple:
    norm = np.sqrt((x * x).sum(axis=1))
    return norm, x / np.where(norm > 0, norm, 1.0)[:, None]


class Cluster:
    """Anchors of one length and near direction; ``of`` are their places in the block."""

    def __init__(self, of, ids, labels, x):
        self.of, self.ids, self.labels, self.x = of, ids, labels, x
        self.norm, unit = directions(x)
        centre = unit.sum(axis=0)
        self.centre = centre / (np.sqrt(centre @ centre) or 1.0)
        cos = (unit @ self.centre)[self.norm > 0]
        self.width = float(np.arccos(np.clip(cos.min(initial=1.0), -1, 1)))

    def bounds(self, norm: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Most that a row can score with a member, over the member's norm."""
        angle = np.arccos(np.clip(unit @ self.centre, -1, 1))
        return norm * np.cos(np.maximum(0.0, angle - self.width - SLACK))


def clusters_of(ids: np.ndarray, labels: np.ndarray, vectors: pa.ListArray) -> list:
    """A block's anchors in about sqrt(anchors) clusters by direction."""
    out = []
    for at, x in by_length(vectors):
        unit = directions(x)[1]
        centres = unit[np.linspace(0, len(at) - 1, int(np.ceil(np.sqrt(len(at))))).astype(int)]
        for _ in range(ROUNDS):
            mine = np.argmax(unit @ centres.T, axis=1)
            centres = np.stack([unit[mine == k].sum(axis=0) if (mine == k).any() else c
                                for k, c in enumerate(centres)])
            centres = directions(centres)[1]
        mine = np.argmax(unit @ centres.T, axis=1)
        out += [Cluster(at[m], ids[at[m]], labels[at[m]], x[m])
                for k in range(len(centres)) if (m := mine == k).any()]
    return out


class Best:
    """The ``k`` best (score, id) of each group, equal scores by id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), NONE, dtype=np.int64)
        self.id = np.full((groups, k), LAST, dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old, k = np.unique(group), self.k
        g = np.r_[np.repeat(old, k), group]
        s = np.r_[self.score[old].ravel(), score]
        i = np.r_[self.id[old].ravel(), ids]
        order = np.lexsort((i, -s, g))
        starts = np.searchsorted(g[order], old)
        top = order[starts[:, None] + np.arange(k)]              # every group has k old places at least
        self.score[old], self.id[old] = s[top], i[top]

    def rows(self) -> tuple:
        g, place = np.nonzero(self.score > NONE)
        return g, self.score[g, place], self.id[g, place]


def scores(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; beyond float64 in Python integers, where a
    score of more than 64 bits is an OverflowError."""
    if exact:
        return (x @ y.T).astype(np.int64)
    big = [np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape) for m in (x, y)]
    return (big[0] @ big[1].T).astype(np.int64) if x.shape[1] else np.zeros((len(x), len(y)), np.int64)


def walk(cluster: Cluster, norm, unit, x, ids, labels, needed, take) -> None:
    """Walk the cluster's list over a slice of rows. ``needed(members)`` is the
    least score that still matters to each member, ``take(members, scores, ids,
    labels)`` uses a step's scores."""
    bound = cluster.bounds(norm, unit)
    order = np.argsort(-bound, kind="stable")
    exact = float(cluster.norm.max(initial=0)) * float(norm.max(initial=0)) < EXACT
    left = np.arange(len(cluster.of))
    for a in range(0, len(order), STEP):
        if exact:
            left = left[cluster.norm[left] * bound[order[a]] + 1 >= needed(left)]
        if not len(left):
            return
        at = order[a:a + STEP]
        take(left, scores(cluster.x[left], x[at], exact), ids[at], labels[at])


def best_of_tasks(rows: DataFrame, clusters, groups: int, k: int, limits=None) -> DataFrame:
    """(grp, score, id, part): what each task keeps. Without ``limits`` the
    groups are anchors and their rows the positives; with limits (low, high per
    anchor and positive) the groups are (anchor, positive) and their rows the
    negatives within the limits."""
    schema = T._parse_datatype_string("grp long, score long, id long, part int")

    def run(batches):
        best = Best(groups, k)
        low, high = limits.value if limits else (None, None)

        def search(x, ids, labels):
            norm, unit = directions(x)
            for c in clusters.value:
                if c.x.shape[1] != x.shape[1]:
                    continue

                def positives(m, s, i, lab):
                    ok = (lab == c.labels[m, None]) & (i != c.ids[m, None]) & (s >= best.score[c.of[m], -1:])
                    u, r = np.nonzero(ok)
                    if len(u):
                        best.add(c.of[m[u]], s[u, r], i[r])

                def negatives(m, s, i, lab):
                    other = lab != c.labels[m, None]
                    for j in range(low.shape[1]):
                        at = c.of[m]
                        group = at * low.shape[1] + j
                        least = np.maximum(low[at, j], best.score[group, -1])
                        u, r = np.nonzero(other & (s >= least[:, None]) & (s <= high[at, j, None]))
                        if len(u):
                            best.add(group[u], s[u, r], i[r])

                def last_positive(m):
                    return best.score[c.of[m], -1]

                def last_negative(m):
                    at = c.of[m]
                    last = best.score[at[:, None] * low.shape[1] + np.arange(low.shape[1]), -1]
                    return np.where(low[at] > high[at], LAST, np.maximum(low[at], last)).min(axis=1)

                walk(c, norm, unit, x, ids, labels, *((last_negative, negatives) if limits
                                                      else (last_positive, positives)))

        def flush(held):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
            for at, x in by_length(t.column("v").combine_chunks()):
                search(x, ids[at], labels[at])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= SLICE_ROWS:
                flush(held)
                held, n = [], 0
        if n:
            flush(held)
        g, s, i = best.rows()
        yield record_batch(schema, {"grp": g, "score": s, "id": i,
                                    "part": np.full(len(g), TaskContext.get().partitionId(), np.int32)})

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each group: first among every 64 tasks, then among the rest."""
    def top(df, *by):
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top(top(rows.withColumn("part", F.expr("part div 64")), "grp", "part").drop("rank"), "grp").drop("part")


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``rows``, null as false. Scores are inner
    products of floor(scale * x), higher ones first, equal ones by id. An
    anchor's positives are its first ``positives`` other rows of its label, a
    positive's negatives the first ``negatives`` rows of other labels whose
    score lies within ``low`` to ``high`` per cent of the positive's.

    Rows without id, label or vector, or with a null or non-finite component
    take no part. Only vectors of the anchor's length meet it. Rows of the
    anchor's id are not its positives; apart from that repeated rows are rows
    of their own. Other columns are not read. Empty tables give no rows.
    """
    spark = rows.sparkSession
    sc, store, out = spark.sparkContext, scratch_path(spark, "vectors"), scratch_path(spark, "negatives")
    whole_vectors(rows, anchor, id_col, label_col, vector_col, scale).write.parquet(store)
    vectors = spark.read.parquet(store)
    anchors = vectors.where("anchor").select("id", "label", "v")
    total = anchors.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    schema = T._parse_datatype_string("anchor_id long, positive_id long, rank int, negative_id long, "
                                      "positive_score long, negative_score long")
    for b in range(blocks):
        # an anchor's own columns decide its block, so that repeats of it do not lie apart
        part = anchors if blocks == 1 else anchors.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == b)
        t = part.toArrow().combine_chunks()
        ids = t.column("id").to_numpy()
        clusters = sc.broadcast(clusters_of(ids, t.column("label").to_numpy(), t.column("v").combine_chunks()))
        found = ranked(best_of_tasks(vectors, clusters, len(ids), positives), positives).collect()
        lo = np.ones((len(ids), positives), dtype=np.int64)          # empty ranges where a positive is missing
        hi = np.zeros((len(ids), positives), dtype=np.int64)
        named = []
        for r in found:
            j = r["rank"] - 1
            lo[r.grp, j], hi[r.grp, j] = -(-low * r.score // 100), high * r.score // 100
            named.append((r.grp * positives + j, int(ids[r.grp]), r.id, r.score))
        limits = sc.broadcast((lo, hi))
        names = spark.createDataFrame(named, "grp long, anchor_id long, positive_id long, positive_score long")
        near = ranked(best_of_tasks(vectors, clusters, len(ids) * positives, negatives, limits), negatives)
        (near.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(names), "grp")
         .select(*schema.names).write.parquet(f"{out}/block={b}"))
        for x in (clusters, limits):
            x.destroy()
    discard(spark, store)
    return spark.read.schema(schema).parquet(*[f"{out}/block={b}" for b in range(blocks)])
