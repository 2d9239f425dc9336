"""Log-likelihood of whole documents under a recurrent language model (``gru``).

1. Every word of the learned documents is counted (partial counts per task,
   then a sum per word). Words of at least 1 / HEAD_SHARE of all tokens and at
   most HEAD_BYTES bytes are the head: fewer than HEAD_SHARE words whatever the
   corpus, so their counts may be broadcast. The WORDS most frequent of them are
   the model's own words, all other words its class of others.
2. Texts are split once: token numbers, sums over the head's words and the
   remaining words with their counts are written per document.
3. The remaining words meet their counts in a join by word. No word of the
   learned text that is frequent takes part in it, however long the tail.
4. All learned documents train the model, in ROUNDS parts: every task trains
   from the common parameters on its share of the part, then the parameters are
   averaged (pieces of them, grouped in two steps) and sent out again.
5. Every document is scored with the state carried from its first to its last
   token; an other word costs p(others | state) times its share of their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import gru
from .common import bytes_of, discard, folded_words, record_batch, scratch_path

WORDS = 4095
HEAD_SHARE = 1 << 20
HEAD_BYTES = 64
ROUNDS = 6

HELD_WORDS = 500_000        # words and bytes that a task counts before it hands counts on
HELD_BYTES = 64 << 20
HELD_TOKENS = 1 << 22       # tokens that are laid out in slots at once
PIECE = 1 << 16             # parameters in a row on their way to the average

END = b""                   # the token behind a text: no word is empty
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else (0x20 if 0x09 <= b <= 0x0D else b) for b in range(256))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c): the tokens of the texts, each text's end included."""
    schema = T._parse_datatype_string("word binary, n long")

    def run(batches):
        def out():
            return record_batch(schema, {"word": list(held), "n": list(held.values())})
        held, size = Counter(), 0
        for b in batches:
            for text in bytes_of(b.column(0)):
                held[END] += 1
                size += len(text or END)
                for words in folded_words(text or END, FOLD):
                    held.update(words)
                    if len(held) > HELD_WORDS or size > HELD_BYTES and sum(map(len, held)) > HELD_BYTES:
                        yield out()
                        held = Counter()
                    size = 0 if size > HELD_BYTES else size
        yield out()

    return docs.select(text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("c"))


class Head:
    """The broadcast words: their numbers by frequency, their logs."""

    def __init__(self, words: list, counts: list, own: int):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.counts = np.array([counts[k] for k in order], dtype=np.int64)
        self.number = {words[k]: i for i, k in enumerate(order)}
        self.own = min(own, len(order))
        self.log = np.log10(self.counts + 0.1)


SPLIT = ("part int, pos long, held boolean, n_tokens long, n_head long, n_other long, head_log double, "
         "other_log double, ids binary, rest array<struct<word:binary,n:long>>, round int")


def split_texts(docs: DataFrame, held: Column, id_col: str, text_col: str, head, rounds: int) -> DataFrame:
    """Documents as token numbers. ``part`` and ``pos`` name the row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held"))
    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string(SPLIT).fields])

    def run(batches):
        h = head.value
        get, own, part, pos = h.number.get, h.own, TaskContext.get().partitionId(), 0
        log_of_other = np.where(np.arange(len(h.log)) < own, 0.0, h.log)
        token = np.minimum(np.r_[np.arange(len(h.log)), own], own).astype(np.uint16)     # of -1: an other word
        end = get(END, -1)
        ending = token[[end]]
        end_known, end_log, end_other = (1, h.log[end], log_of_other[end]) if end >= 0 else (0, 0.0, 0.0)
        for b in batches:
            cols: dict = {f.name: [] for f in schema[2:] if f.name != "rest"}
            rest_words, rest_counts, rest_ends = [], [], [0]
            for text, out in zip(bytes_of(b.column(1)), b.column(2).to_pylist()):
                rest, ids, n_head, head_log, other_log = Counter(), [], end_known, end_log, end_other
                for words in folded_words(text or END, FOLD):
                    at = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    ids.append(token[at])
                    unknown = at < 0
                    if unknown.any():
                        rest.update([words[k] for k in np.flatnonzero(unknown).tolist()])
                        at = at[~unknown]
                    n_head += len(at)
                    head_log += h.log[at].sum()
                    other_log += log_of_other[at].sum()
                if end < 0:
                    rest[END] += 1
                ids = np.concatenate((*ids, ending))
                for name, x in (("pos", pos), ("held", out), ("n_tokens", len(ids)), ("n_head", n_head),
                                ("n_other", int((ids == own).sum())), ("head_log", head_log),
                                ("other_log", other_log), ("ids", ids.tobytes()),
                                ("round", -1 if out else pos % rounds)):
                    cols[name].append(x)
                rest_words += rest
                rest_counts += rest.values()
                rest_ends.append(len(rest_words))
                pos += 1
            rest = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_counts, pa.int64())],
                                              ["word", "n"])
            yield record_batch(schema, {"doc_id": b.column(0), "part": [part] * len(b), **cols,
                                        "rest": pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), rest)})

    return src.mapInArrow(run, schema)


def in_batches(batches, column: str):
    """(batches, their documents' token numbers) of about HELD_TOKENS tokens."""
    held, docs, n = [], [], 0
    for b in batches:
        held.append(b)
        for x in b.column(b.schema.get_field_index(column)).to_pylist():
            docs.append(np.frombuffer(x, dtype=np.uint16).astype(np.int32))
            n += len(docs[-1])
        if n >= HELD_TOKENS:
            yield held, docs
            held, docs, n = [], [], 0
    if held:
        yield held, docs


PIECES = "piece int, salt int, tokens double, numbers binary"


def trained(docs: DataFrame, layout, start: np.ndarray, seen: np.ndarray, hidden: int, rate: float) -> tuple:
    """One round: every task trains on its documents, the results are averaged
    by the tokens behind them."""
    sc, schema = docs.sparkSession.sparkContext, T._parse_datatype_string(PIECES)
    common = sc.broadcast((layout, start, seen))

    def run(batches):
        lay, flat, sums = common.value
        flat, sums, n = flat.copy(), sums.copy(), 0
        for _, texts in in_batches(batches, "ids"):
            n += gru.train(lay, flat, sums, texts, hidden, rate)
        both, part = np.concatenate([flat, sums]), TaskContext.get().partitionId()
        at = range(0, len(both) if n else 0, PIECE)
        yield record_batch(schema, {
            "piece": [a // PIECE for a in at], "salt": [part // 64 for _ in at], "tokens": [float(n) for _ in at],
            "numbers": [both[a:a + PIECE].tobytes() for a in at]})

    def mean(t: pa.Table) -> pa.Table:
        w = t.column("tokens").to_numpy()
        total = np.zeros(len(t.column("numbers")[0].as_py()) // 4)
        for x, k in zip(t.column("numbers"), w):
            total += k * np.frombuffer(x.as_py(), dtype=np.float32)
        return pa.table({"piece": t.column("piece")[:1], "salt": pa.array([0], pa.int32()), "tokens": [w.sum()],
                         "numbers": [(total / w.sum()).astype(np.float32).tobytes()]})

    rows = docs.select("ids").coalesce(sc.defaultParallelism).mapInArrow(run, PIECES)
    rows = rows.groupBy("piece", "salt").applyInArrow(mean, PIECES).groupBy("piece").applyInArrow(mean, PIECES)
    got = sorted(rows.select("piece", "numbers").collect())
    common.destroy()
    if not got:
        return start, seen
    both = np.concatenate([np.frombuffer(x, dtype=np.float32) for _, x in got])
    return both[:len(start)], both[len(start):]


def likelihoods(split: DataFrame, layout, flat: np.ndarray, hidden: int) -> DataFrame:
    """The documents with ``model``: natural log probability of the token numbers."""
    src = split.drop("rest", "round")
    schema = T.StructType([*src.drop("ids").schema.fields, T.StructField("model", T.DoubleType())])
    model = split.sparkSession.sparkContext.broadcast((layout, flat))

    def run(batches):
        for held, texts in in_batches(batches, "ids"):
            log, a = gru.log_likelihoods(*model.value, texts, hidden), 0
            for b in held:
                yield record_batch(schema, {**{f.name: b.column(b.schema.get_field_index(f.name))
                                               for f in schema[:-1]}, "model": log[a:a + len(b)]})
                a += len(b)

    return src.mapInArrow(run, schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
          hidden: int = gru.HIDDEN, rounds: int = ROUNDS, rate: float = gru.RATE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words of the A-Z-lower-cased text and one end. The model
    learns from the documents that are not ``held_out`` (null: held out).
    ``base_score`` is the unigram log10 probability with 0.1 added to every
    count, ``score`` the recurrent model's; a word that no learned document
    holds costs, in both, what a count of zero costs.

    A null text is empty: its only token is the end. Repeated documents are a
    row each and are learned from as often. Without learned documents both
    scores are 0. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    at = {name: scratch_path(spark, f"lm-{name}") for name in ("counts", "split", "scores")}
    held_out = F.coalesce(held_out, F.lit(True))
    word_counts(docs.where(~held_out), text_col).write.parquet(at["counts"])
    counts = spark.read.parquet(at["counts"])
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = (F.col("c") >= n / HEAD_SHARE) & (F.length("word") <= HEAD_BYTES)
    t = counts.where(frequent).toArrow()
    head = Head(t.column("word").to_pylist(), t.column("c").to_pylist(), words)
    own = head.counts[:head.own]
    layout, others = gru.Layout(own, n - own.sum()), n - int(own.sum()) + 0.1 * (v - head.own + 1)

    sent = sc.broadcast(head)
    split_texts(docs, held_out, id_col, text_col, sent, rounds).write.partitionBy("round").parquet(at["split"])
    sent.destroy()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           *T._parse_datatype_string(SPLIT).fields])
    split = spark.read.schema(schema).parquet(at["split"])

    flat = layout.start(hidden)
    seen = np.zeros_like(flat)
    for r in range(rounds):
        flat, seen = trained(split.where(F.col("round") == r), layout, flat, seen, hidden, rate)

    rest = (split.select("part", "pos", F.explode("rest").alias("r")).select("part", "pos", "r.*")
            # words are counted once, so no part of the hash table is larger than others
            .join(counts.where(~frequent).hint("shuffle_hash"), "word").groupBy("part", "pos")
            .agg(F.sum("n").alias("n_rest"), F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("rest_log")))
    all_tokens, n_rest = F.col("n_tokens"), F.coalesce("n_rest", F.lit(0))
    n_known = F.col("n_head") + n_rest
    tail_log = F.coalesce("rest_log", F.lit(0.0)) - (all_tokens - n_known)      # log10(0.1) for each unknown
    (likelihoods(split, layout, flat, hidden).join(rest, ["part", "pos"], "left")
     .select("doc_id", F.col("held").alias("held_out"), "n_tokens", n_known.alias("n_known"),
             F.lit(int(n)).cast("long").alias("train_tokens"),
             (F.col("head_log") + tail_log - all_tokens * math.log10(n + 0.1 * (v + 1))).alias("base_score"),
             (F.col("model") / math.log(10) + F.col("other_log") + tail_log
              - F.col("n_other") * math.log10(others)).alias("score"))
     .write.parquet(at["scores"]))
    for name in ("counts", "split"):
        discard(spark, at[name])
    return spark.read.parquet(at["scores"])
