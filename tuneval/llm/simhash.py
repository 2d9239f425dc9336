"""SimHash near-duplicates: fingerprints linked through BK-trees.

Two fingerprints that differ in at most ``radius`` of 64 bits agree on
``blocks - radius`` whole blocks if the bits are cut into ``blocks`` blocks.
Every choice of that many blocks and their value is a shard; a shard's
fingerprints form BK-trees, which are shipped to the tasks that search them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bktree import Forest, spanning
from .common import checkpoint, per_text, written
from .components import components

SHINGLE = 3
RADIUS = 3
BLOCKS = 5          # 10 shards per fingerprint, chosen by about 26 bits each
TREE = 1024         # most fingerprints of one tree; a larger shard has several
AT_ONCE = 1 << 14   # rows that a task builds trees of at a time
QUERIES = 1 << 11   # of them, searched at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles (XXH64, seed 42) as a signed number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(n + 1) - 1
        starts, ends = (end - n)[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, dtype=np.int64), len(starts)
    for a in range(0, count, 1 << 16):
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[a:a + (1 << 16)], ends[a:a + (1 << 16)])),
                        dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document; no words (or null text) give 0."""
    def make():
        return lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}
    return per_text(docs, id_col, text_col, "fp long", make)


def _masks(blocks: int, radius: int) -> list:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _sharded(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows (shard, in_tree, asks, fp): what meets in one BK-tree search.

    A shard of more than TREE fingerprints is dealt to several trees by a
    hash; the fingerprints of tree j then also search the trees before it, so
    no pair of a shard is left out and no group holds more than two trees.
    """
    masks = F.array(*[F.lit(m) for m in _masks(blocks, radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("c", "mask")) \
              .select("fp", "c", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    large = (rows.groupBy("c", "value").count().where(F.col("count") > TREE)
                 .select("c", "value", F.ceil(F.col("count") / F.lit(TREE * 0.8)).cast("long").alias("trees")))
    rows = rows.join(written(large, "simhash-large"), ["c", "value"], "left") \
               .withColumn("trees", F.coalesce("trees", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(F.lit("tree").cast("string"), "fp"), F.col("trees"))
    rows = rows.withColumn("own", own) \
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(F.xxhash64("c", "value", low, high).alias("shard"),
                       (F.col("own") == low).alias("in_tree"), (F.col("own") == high).alias("asks"), "fp")


def _search(radius: int):
    """Batches sorted by shard -> links (u, v), spanning each shard's near pairs."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(shard, in_tree, asks, fp):
        t, q = np.flatnonzero(in_tree), np.flatnonzero(asks)
        forest = Forest(shard[t], fp[t])
        pairs = ((q[a + x], t[y]) for a in range(0, len(q), QUERIES)
                 for x, y in forest.search(shard[q[a:a + QUERIES]], fp[q[a:a + QUERIES]], radius))
        root = spanning(len(fp), pairs)
        at = np.flatnonzero((root != np.arange(len(fp))) & (fp[root] != fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)),
                                           pa.array(fp[root[at]].view(np.int64))], schema=schema)

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False),
                    b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)]
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            if len(held[0]) >= AT_ONCE:
                end = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
                if end:
                    yield links(*[c[:end] for c in held])
                    held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield links(*held)
    return run


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct (fp) -> links (u, v) with the same components as all pairs of
    fingerprints within ``radius`` bits.

    Inside a shard only a spanning set of links is returned, so a dense group
    of near copies yields links in proportion to its size, not its square.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_sharded(fps, radius, blocks).repartition(n, "shard").sortWithinPartitions("shard")
            .mapInArrow(_search(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document.

    ``component_id`` is the least non-null id in reach over links of at most
    ``radius`` bits. Texts without words (empty or null) share fingerprint
    zero and link like others. A null id gets a row and the component of its
    text (null if no id is in reach). Repeated ids keep their rows. An empty
    table gives no rows. Copies meet as one fingerprint before any search.
    """
    fp = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    first = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(near_links(first.select("fp"), radius, blocks))
    linked = written(first.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root"), "simhash-roots")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    comp = linked.join(least, "root").select("fp", "least", F.lit(True).alias("linked"))
    per_fp = written(first.join(comp, "fp", "left")
                          .select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first"))
                                  .alias("component_id")), "simhash-components")
    return (fp.join(per_fp, "fp")
              .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, all columns as they are: the least id
    (null ids last), then the least hash of the row; of equal rows, one."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.xxhash64(*cols).alias("c"))
    tagged = docs.select(key.alias("__key"), F.col(text_col).alias("__text"), F.struct(*cols).alias("__row"))
    stay = written(near_duplicates(tagged, "__key", "__text", **how)
                   .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                   .groupBy(F.col("doc_id.b").alias("b"), F.col("doc_id.c").alias("c")).count(), "simhash-stay")
    equal = written(stay.where("count > 1"), "simhash-equal")   # of rows that occur more than once

    def rows(keys):
        return tagged.join(keys, F.col("__key.b").eqNullSafe(F.col("b")) & (F.col("__key.c") == F.col("c")))

    out = [F.col(f"__row.`{c}`") for c in docs.columns]
    return (rows(stay.where("count = 1")).select(*out)
            .unionByName(rows(equal).dropDuplicates(["b", "c"]).select(*out)))
