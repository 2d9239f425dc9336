"""Token ids as Parquet list columns, in document order.

Texts are range-partitioned by id, encoded, and written by Spark's Parquet
writer: dictionary-encoded ids, delta-encoded counters (format version 2),
row groups and pages of set sizes, page indexes. Readers that want only the
counters, or only some ids, skip the rest.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import bytes_of, kept, record_batch
from .vocab import Vocab, read_spec, to_alphabet

END = 1
# What a worker keeps the ids of: words and parts of words, until their bytes and
# KEY_BYTES for each go beyond these.
WORD_BYTES = 128 << 20
PART_BYTES = 64 << 20
KEY_BYTES = 100
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

# The pre-token pattern of the lower-cased word vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words whose letters are Latin-1, with marks behind them: the tokenizer cuts
# the marks off as one run, and lower-cases the letters one by one.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$&*#|]*)")

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.page.write-checksum.enabled": "true",
}


def check_spec(spec: str) -> None:
    """Words are split by the rules below: a tokenizer with others is an error."""
    parsed = json.loads(spec)
    steps = [s["type"] for s in (parsed["normalizer"] or {}).get("normalizers", [])]
    pre = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [])
    fits = (steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == PATTERN and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
            and parsed["model"].get("end_of_word_suffix"))
    if not fits:
        raise ValueError("not a tokenizer of lower-cased words with their end marked: "
                         f"normalizer {parsed['normalizer']}, pre-tokenizer {parsed['pre_tokenizer']}")


class IdTable(dict):
    """key -> row; a row is a run of ids in one growing array.

    Unknown keys get the next rows and are resolved together, so that the
    merging works on many at a time. The table starts anew once its keys take
    more than ``limit`` bytes; a batch of texts adds no more than its own.
    """

    def __init__(self, resolve, limit: int):
        super().__init__()
        self.resolve, self.limit = resolve, limit
        self.reset()

    def reset(self):
        self.clear()
        self.size, self.unknown = 0, []
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)    # of rows, after a leading 0

    def __missing__(self, key):
        row = self[key] = len(self)
        self.unknown.append(key)
        return row

    def take(self, keys: list) -> tuple:
        """(number of ids of each key, ids of all keys one after the other)."""
        if self.size > self.limit:
            self.reset()
        known = len(self)
        rows = np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))
        if self.unknown:
            new, self.unknown = self.unknown, []
            self.size += sum(map(len, new)) + KEY_BYTES * len(new)
            n, ids = self.resolve(new)
            self.ends = _room(self.ends, known + 1 + len(n))
            start = self.ends[known]
            self.ends[known + 1:known + 1 + len(n)] = start + np.cumsum(n)
            self.ids = _room(self.ids, start + len(ids))
            self.ids[start:start + len(ids)] = ids
        first = self.ends[rows]
        n = self.ends[rows + 1] - first
        return n, self.ids[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]


def _room(a: np.ndarray, size: int) -> np.ndarray:
    if len(a) >= size:
        return a
    out = np.zeros(max(size, 2 * len(a)), dtype=a.dtype)
    out[:len(a)] = a
    return out


class Encoder:
    """Token ids of whole texts, as the tokenizer gives them.

    The word tokenizer drops white space and never joins what it separates,
    and no special string holds any, so a text's ids are those of its
    space-separated words one after the other. Words are remembered, and so
    are their parts (letters in lower case, marks), which are merged many at
    a time by the tokenizer's own merges.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.vocab = Vocab(spec)
        model = json.loads(spec)["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0,
                                           end_of_word_suffix=suffix))
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.is_last = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.is_last[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.parts = IdTable(self.merge_parts, PART_BYTES)
        self.words = IdTable(self.split_words, WORD_BYTES)

    def merge_parts(self, parts: list) -> tuple:
        """Every part is one word of the merges: its last token tells so."""
        mapped = [p if p.isascii() else to_alphabet(p) for p in parts]
        lines = [" ".join(mapped[a:a + 1000]) for a in range(0, len(mapped), 1000)]
        ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in
                              self.merges.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_last[ids]) + 1
        return np.diff(ends, prepend=0), ids

    def split_words(self, words: list) -> tuple:
        """Words of simple form as their parts, the others as the tokenizer has them."""
        parts, count, others = [], np.zeros(len(words), dtype=np.int64), []
        for i, w in enumerate(words):
            s = w.decode("utf-8", "replace")
            m = _SIMPLE.fullmatch(s)
            if m:
                parts.append(m[1].lower())
                if m[2]:
                    parts.append(m[2])
                count[i] = 1 + bool(m[2])
            else:
                others.append((i, s))
        per_part, ids = self.parts.take(parts)
        at = np.concatenate([[0], np.cumsum(per_part)])[np.concatenate([[0], np.cumsum(count)])]
        n = np.diff(at)
        if others:
            made = self.vocab.tokenizer.encode_batch_fast([s for _, s in others], add_special_tokens=False)
            where = [i for i, _ in others]
            ids = np.insert(ids, np.repeat(at[where], [len(e.ids) for e in made]),
                            np.fromiter(chain.from_iterable(e.ids for e in made), dtype=np.int32))
            n[where] = [len(e.ids) for e in made]
        return n, ids

    def encode(self, texts: list, end: int = END) -> tuple:
        """(number of ids of each text, ids of all texts); each ends with ``end``."""
        words = [(t or b"").split() for t in texts]
        n, ids = self.words.take(list(chain.from_iterable(words)))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(w) for w in words], dtype=np.int64)]
        return np.diff(ends, prepend=0) + 1, np.insert(ids, ends, np.int32(end))


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", end: int = END) -> None:
    """Write (part, doc_id, offset, n_tokens, ids) in ascending id order.

    ``part`` numbers the range partitions, ``offset`` counts the ids before a
    document in its part. Null ids come first; equal ids are ordered by a
    hash of their text and may be spread over parts, so no id is too frequent
    for one task. Null and empty texts are the end id alone. An empty table
    writes a readable table of no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    spec = read_spec(tokenizer_path)
    check_spec(spec)
    key, shipped = hashlib.sha256(spec.encode()).hexdigest(), spark.sparkContext.broadcast(spec)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(F.col(text_col)).alias("h"), F.spark_partition_id().alias("p"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), src.schema["doc_id"],
                           T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            enc = kept(f"encoder {key}", lambda: Encoder(shipped.value))     # tasks share the words that were encoded
            n, ids = enc.encode(bytes_of(b.column(1)), end)
            stop = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(ids))
            yield record_batch(schema, {"part": np.full(len(n), part, np.int32), "doc_id": b.column(0),
                                        "offset": at + stop - n, "n_tokens": n, "ids": lists})
            at += int(n.sum())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h", "p")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "p")
        .mapInArrow(run, schema)
        .write.options(**WRITER).mode("overwrite").parquet(out))


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids before each part. One row per written
    partition, whatever the number of documents; reads two counters only."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written table; ``start`` counts the
    ids of all documents before. Columns and ranges of doc_id that are not
    asked for are not read."""
    files = spark.read.parquet(out)
    return (files.join(F.broadcast(part_starts(files)), "part")
                 .select("doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids that were read."""
    schema = T.StructType([tokens.schema["doc_id"], T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
            yield record_batch(schema, {"doc_id": b.column(0), "start": b.column(1),
                                        "n_tokens": np.diff(at).astype(np.int64),
                                        "ids_crc32": [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at, at[1:])]})

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, schema)
