"""Importance resampling: which documents look more like the target texts.

Two bag-of-n-grams models over the same hash buckets, one of the target
texts and one of the raw corpus, give every document a log weight. Gumbel
noise on the log weights and a top-k draw a sample without replacement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, per_text, unit, written
from .ngrams import WordHashes, word_grams

SEED = 42
BUCKET_BITS = 18
PRIOR = 5.0            # occurrences that either model is taken to have beforehand in every bucket
NOISE = 3.0
UNIT = 1000             # steps of a document's weight
TARGET_DOCS = 20_000    # expected size of the hash sample of target documents
RADIX = 16              # bits of the rank key settled by one pass


class Buckets:
    """Bucket numbers of a text's lower-case word 1- and 2-grams."""

    def __init__(self):
        self.hashes = WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        h = self.hashes.of((text or b"").lower().split())
        shift = np.uint64(64 - BUCKET_BITS)
        return np.concatenate([(word_grams(h, n) >> shift).astype(np.int64) for n in (1, 2)])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(text, weight) -> (bucket, n): weights (long) summed over the n-grams of
    a bucket; each task adds up its documents first."""
    def run(batches):
        b, total = Buckets(), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            at = [b.of(t) for t in bytes_of(batch.column(0))]
            weights = batch.column(1).to_pylist()
            for w in set(weights):
                total += w * np.bincount(np.concatenate([a for a, x in zip(at, weights) if x == w]),
                                         minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 14):
            c = at[a:a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(total[c])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame) -> np.ndarray:
    """Counts of all buckets; at most a row per bucket reaches the driver."""
    got, out = counts.toArrow(), np.zeros(1 << BUCKET_BITS)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def stratum_weights(docs: DataFrame, target: DataFrame, stratum: str, text_col: str = "text") -> DataFrame:
    """(stratum, weight): how much larger a stratum's part of the corpus's
    text is than its part of the target text, in steps of 1 / UNIT. A row per
    stratum."""
    def shares(d):
        n = d.groupBy(F.col(stratum).alias("s")).agg(F.sum(F.octet_length(text_col) + 1).alias("size"))
        total = n.agg(F.sum("size").alias("total"))
        return n.join(F.broadcast(total)).select("s", F.try_divide("size", "total").alias("share"))
    raw, tgt = shares(docs), shares(target).select(F.col("s").alias("t"), F.col("share").alias("of"))
    return written(tgt.join(raw, F.col("s").eqNullSafe(F.col("t")))
                      .select("s", F.coalesce(F.round(F.try_divide("share", "of") * UNIT).cast("long"),
                                               F.lit(0).cast("long")).alias("weight")),
                   "importance-strata")


def log_ratio(docs: DataFrame, target: DataFrame, text_col: str = "text",
              stratum_col: str | None = None) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) for every bucket.

    The raw model counts all documents, and its counts are scaled to the
    number of n-grams of the target. With ``stratum_col`` (the language, say)
    the target documents are weighted to the corpus's shares of its values,
    so that the ratio tells good text from bad and not one stratum from
    another. Both models start from PRIOR occurrences in every bucket, and
    buckets whose target count is within NOISE standard deviations of what
    the raw model expects weigh 0: rare n-grams say nothing, and what the
    corpus often shows but the target never does weighs low, yet finitely.
    Without target texts all buckets weigh 0.
    """
    raw = _vector(bucket_counts(docs.select(F.col(text_col).alias("t"), F.lit(UNIT).cast("long"))))
    src = target.select(F.col(text_col).alias("t"), F.lit(UNIT).cast("long"))
    if stratum_col:
        w = stratum_weights(docs, target, stratum_col, text_col)
        src = target.join(w, F.col(stratum_col).eqNullSafe(F.col("s"))).select(F.col(text_col).alias("t"), "weight")
    tgt = _vector(bucket_counts(src)) / UNIT
    if not raw.sum() or not tgt.sum():
        return np.zeros(1 << BUCKET_BITS)
    expected = raw * (tgt.sum() / raw.sum())
    told = np.abs(tgt - expected) > NOISE * np.sqrt(expected + 1)
    return np.where(told, np.log(tgt + PRIOR) - np.log(expected + PRIOR), 0.0)


def target_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     rows: int = TARGET_DOCS, seed: int = SEED) -> tuple:
    """(target documents, share of the labelled that are target).

    Target: every label says quality 1 and not toxic. The share counts all
    labelled documents; the texts are those of a hash sample of about
    ``rows`` target ids, which bounds what is broadcast.
    """
    good = F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)))
    lab = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(good.alias("good"))
    n, k = lab.agg(F.count("*"), F.count_if("good")).first()
    ids = lab.where(F.col("good") & (unit(seed, F.col("__id")) < min(1.0, rows / max(k, 1)))).select("__id")
    return docs.join(F.broadcast(ids), docs[id_col] == F.col("__id"), "left_semi"), (k / n if n else 1.0)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a column ``key`` of non-negative longs below 2^48,
    found 16 bits at a time: each pass counts the keys under the settled
    prefix by their next bits, so at most 65,536 counts reach the driver."""
    low, high, left = 0, 1 << 48, k
    for shift in (32, 16, 0):
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << RADIX) - 1))
        counts = (keys.where((F.col("key") >= low) & (F.col("key") < high)).groupBy(digit.cast("int").alias("d"))
                      .count().collect())
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                low, high = low + (d << shift), low + ((d + 1) << shift)
                break
            left -= n
        else:
            return None
    return low


def resample(docs: DataFrame, weights: np.ndarray, share: float, id_col: str = "doc_id",
             text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept for every document.

    ``key`` = log weight + Gumbel noise from a hash of seed, id and text;
    the ceil(share x documents) largest keys are kept (equal keys at the
    limit all stay). Keys are compared in steps of 2^-20. Null and empty
    texts have weight 0, repeated rows equal keys, null ids a key of their
    text. An empty table gives no rows.
    """
    w = docs.sparkSession.sparkContext.broadcast(weights)
    src = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h")).alias("__id"),
                      F.col(text_col).alias("__text"))

    def make():
        b, v = Buckets(), w.value

        def run(texts):
            at = [b.of(t) for t in texts]
            return {"n_grams": [len(a) for a in at], "log_weight": [float(v[a].sum()) for a in at]}
        return run

    scored = per_text(src, "__id", "__text", "n_grams long, log_weight double", make)
    u = unit(seed, F.col("doc_id.i"), F.col("doc_id.h")) + F.lit(2.0 ** -54)
    scored = written(scored.select(F.col("doc_id.i").alias("doc_id"), "n_grams", "log_weight",
                                   (F.col("log_weight") - F.log(-F.log(u))).alias("gumbel")), "importance-scored")
    half = float(1 << 47)
    step = F.greatest(F.lit(0.0), F.least(F.lit(2 * half - 1), F.floor(F.col("gumbel") * (1 << 20)) + half))
    keyed = scored.withColumn("key", step.cast("long"))
    n = scored.count()
    limit = kth_largest(keyed, -int(-share * n // 1)) if n and share > 0 else None
    return keyed.select("doc_id", "n_grams", "log_weight", F.col("gumbel").alias("key"),
                        (F.col("key") >= F.lit(limit) if limit is not None else F.lit(False)).alias("kept"))
