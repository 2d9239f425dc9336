"""Ranked lexical search by dense blocked matrix products.

A term is a run of ASCII letters and digits and of any characters beyond
ASCII, with only A-Z lower-cased; on UTF-8 bytes that is a run of bytes the
table below does not turn into a space. The items are a stated query set:
they reach the tasks in blocks of bounded text, and every block is matched
against all documents in three Spark jobs:

1. documents -> (doc_id, n, ids, tfs): the document's number of terms and the
   block's terms it holds. Written, so that texts are split once per block;
2. N, L and the document frequencies, summed before the shuffle;
3. scores. A batch of documents is a dense float64 tile of impacts, a group
   of items a dense float64 tile of weights over the terms that both hold, and
   BLAS multiplies the two. The terms are cut into tiles whose sums stay below
   2^53, so that every product is an exact integer; tiles are added as int64.
   A task keeps each item's best rows, ties included by document id, and Spark
   ranks what the tasks kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import bytes_of, discard, folded_words, record_batch, scratch_path

# Characters of item text per block, items and terms per dense tile.
BLOCK_CHARS = 4_000_000
TILE_ITEMS = 256
TILE_TERMS = 2048

EXACT = 1 << 53
MAX_IMPACT = 10**6          # 10^9 tf div (1000 tf + 8 m) is below it, as m >= 25

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 or b in _LETTERS else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


def terms(text: bytes) -> Iterator[list]:
    """The terms of a text, as lists of bounded length."""
    return folded_words(text, _FOLD)


class Block:
    """A block of items: its terms and, per item, how often it repeats each."""

    def __init__(self, rows: list):
        self.ids = [r[0] for r in rows]
        self.vocab: dict[bytes, int] = {}
        item, term, times = [], [], []
        for k, (_, text) in enumerate(rows):
            seen: Counter = Counter()
            for words in terms(text.encode("utf-8", "surrogatepass")):
                seen.update(words)
            for w, n in seen.items():
                item.append(k)
                term.append(self.vocab.setdefault(w, len(self.vocab)))
                times.append(n)
        self.item, self.term, self.times = (np.array(x, dtype=np.int64) for x in (item, term, times))

    def tiles(self, weights: np.ndarray) -> list:
        """(first item, items, term ids, item, term place, weight) of each group
        of TILE_ITEMS items: sparse, made dense when it is multiplied."""
        out = []
        for a in range(0, len(self.ids), TILE_ITEMS):
            lo, hi = np.searchsorted(self.item, (a, a + TILE_ITEMS))
            ids, at = np.unique(self.term[lo:hi], return_inverse=True)
            out.append((a, min(TILE_ITEMS, len(self.ids) - a), ids, self.item[lo:hi] - a, at,
                        self.times[lo:hi] * weights[self.term[lo:hi]]))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The items with a text, equal rows once, in blocks of about ``block_chars``."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = total // block_chars + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Block(sorted(map(tuple, part.collect()), key=lambda r: (str(r[0]), r[1])))


def held_terms(docs: DataFrame, id_col: str, text_col: str, vocab) -> DataFrame:
    """(doc_id, n, ids, tfs) of the documents with a term; ``vocab`` is a
    broadcast dictionary term -> id."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType),
                           *T._parse_datatype_string("n long, ids array<int>, tfs array<int>").fields])

    def run(batches):
        get = vocab.value.get
        for b in batches:
            keep, ns, ids, tfs = [], [], [], []
            for k, text in enumerate(bytes_of(b.column(1))):
                n, found = 0, []
                for words in terms(text):
                    n += len(words)
                    at = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    found.append(at[at >= 0])
                if n:
                    u, c = np.unique(np.concatenate(found), return_counts=True)
                    keep.append(k)
                    ns.append(n)
                    ids.append(u)
                    tfs.append(c.astype(np.int32))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32),
                                              np.concatenate([np.empty(0, np.int32), *x])) for x in (ids, tfs)]
            yield record_batch(schema, {"doc_id": b.column(0).take(pa.array(keep, pa.int64())), "n": ns,
                                        "ids": lists[0], "tfs": lists[1]})

    return src.mapInArrow(run, schema)


def product(impacts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """impacts (documents x terms) times weights (terms x items), both whole
    numbers in float64, exactly, as int64."""
    out = np.zeros((impacts.shape[0], weights.shape[1]), dtype=np.int64)
    most = weights.max(axis=1, initial=0) * MAX_IMPACT
    for k in np.flatnonzero(most >= EXACT):            # an item that repeats a term hundreds of thousands of times
        out += impacts[:, k, None].astype(np.int64) * weights[k].astype(np.int64)
    cols, a = np.flatnonzero(most < EXACT), 0
    sums = np.cumsum(most[cols])
    while a < len(cols):
        below = sums[a - 1] if a else 0.0
        b = min(a + TILE_TERMS, max(a + 1, int(np.searchsorted(sums, below + EXACT / 2))))
        out += (impacts[:, cols[a:b]] @ weights[cols[a:b]]).astype(np.int64)
        a = b
    return out


class Best:
    """Each item's ``k`` best (score, document), equal scores by document id."""

    def __init__(self, items: int, k: int, id_type: pa.DataType):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.rows = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()),
                              "doc_id": pa.array([], id_type)})

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of documents (rows) for items from ``first`` on (columns)."""
        doc, item = np.nonzero(scores >= self.least[first:first + scores.shape[1]])
        if not len(doc):
            return
        new = pa.table({"item": item + first, "score": scores[doc, item], "doc_id": ids.take(pa.array(doc))})
        both = pa.concat_tables([self.rows, new])
        both = both.take(pc.sort_indices(both, sort_keys=[("item", "ascending"), ("score", "descending"),
                                                          ("doc_id", "ascending")], null_placement="at_end"))
        at = both.column("item").to_numpy()
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        self.rows = both.filter(pa.array(place < self.k)).combine_chunks()
        full = place == self.k - 1
        self.least[at[full]] = both.column("score").to_numpy()[full]


def best_of_tasks(held: DataFrame, tiles, n_docs: int, n_terms: int, items: int, k: int) -> DataFrame:
    """(item, score, doc_id, part): the best rows of each task."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()),
                           T.StructField("doc_id", held.schema["doc_id"].dataType),
                           T.StructField("part", T.IntegerType())])

    def run(batches):
        best = None
        for b in batches:
            ids = b.column(0)
            best = best or Best(items, k, ids.type)
            n = b.column(1).to_pylist()
            m = np.array([25 + 75 * x * n_docs // n_terms for x in n], dtype=np.int64)
            doc = np.repeat(np.arange(len(n)), pc.list_value_length(b.column(2)).to_numpy())
            term = b.column(2).flatten().to_numpy()
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            impact = (10**9 * tf) // (1000 * tf + 8 * m[doc])
            for first, width, known, item, at, weight in tiles.value:
                place = np.searchsorted(known, term)
                hit = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == term) if len(known) else place < 0
                if not hit.any():
                    continue
                used, col = np.unique(place[hit], return_inverse=True)
                dense = np.zeros((len(n), len(used)))
                dense[doc[hit], col] = impact[hit]
                row = np.searchsorted(used, at)
                here = used[np.minimum(row, len(used) - 1)] == at
                weights = np.zeros((len(used), width))
                weights[row[here], item[here]] = weight[here]
                best.add(first, product(dense, weights), ids)
        if best:
            part = TaskContext.get().partitionId()
            yield record_batch(schema, {"item": best.rows.column("item").combine_chunks(),
                                        "score": best.rows.column("score").combine_chunks(),
                                        "doc_id": best.rows.column("doc_id").combine_chunks(),
                                        "part": [part] * len(best.rows)})

    return held.mapInArrow(run, schema)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their rank: first among every 64
    tasks, then among what is left."""
    def top(df, *groups):
        w = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    some = top(rows.withColumn("part", F.expr("part div 64")), "item", "part").drop("rank")
    return top(some, "item").select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.

    Null and empty texts, of documents or items, hold no term and meet nothing.
    Documents without id rank after others of their score; repeated documents
    are a row each and count as such in all statistics; equal items are
    searched once, items of one id and different texts each on its own. Other
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    sc, out = spark.sparkContext, scratch_path(spark, "ranked")
    schema = T.StructType([T.StructField("item_id", items.schema[item_col].dataType),
                           T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("score", T.LongType())])
    for number, block in enumerate(item_blocks(items, item_col, item_text_col, block_chars)):
        vocab, path = sc.broadcast(block.vocab), scratch_path(spark, "held-terms")
        held_terms(docs, id_col, text_col, vocab).write.parquet(path)
        held = spark.read.parquet(path)
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(block.vocab), dtype=np.int64)
        for i, df in held.select(F.explode("ids").alias("i")).groupBy("i").count().collect():
            weights[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        tiles = sc.broadcast(block.tiles(weights))
        names = spark.createDataFrame(list(enumerate(block.ids)),
                                      T.StructType([T.StructField("item", T.LongType()), schema[0]]))
        best = ranked(best_of_tasks(held, tiles, n_docs, max(n_terms, 1), len(block.ids), k), k)
        best.join(F.broadcast(names), "item").select(*schema.names).write.parquet(f"{out}/block={number}")
        for x in (vocab, tiles):
            x.destroy()
        discard(spark, path)
    return spark.read.schema(schema).parquet(*[f"{out}/block={b}" for b in range(number + 1)])
