"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one table of slots; a slot holds one bit per language.
The AND of an n-gram's slots is the set of languages whose filter contains
it. A document's n-grams are looked up, hits are counted per language bit,
corrected for the filters' false positives, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, per_text, unit
from .ngrams import char_grams, codepoints, pieces

SEED = 42
GRAM = 4
SLOT_BITS = 21          # slots = 2 ** SLOT_BITS; an n-gram sets three
HASHES = 3
SAMPLE_DOCS = 1500      # expected training documents of each language
DOMINANCE = 0.3
MIN_DOCS = 2

_SPACE = np.uint32(32)
_LETTERS: list = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def letter_stream(text: str) -> np.ndarray:
    """Lower-case letters; every other run is one space, two at the ends."""
    cp = codepoints(text.lower())
    is_letter = letters()[cp]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]      # the first of a run of others stays, as a space
    out = np.where(is_letter, cp, _SPACE)[keep]
    return np.concatenate([[_SPACE, _SPACE], out, [_SPACE, _SPACE]]).astype(np.uint32)


def grams(text: str, n: int = GRAM):
    """Arrays of the text's n-gram hashes, a bounded number at a time."""
    for p in pieces(letter_stream(text), n):
        yield char_grams(p, n)


@dataclass
class LanguageFilters:
    """languages[i] is bit i % 64 of word i // 64 of a slot in ``table``."""

    languages: list
    table: np.ndarray        # (slots, words)
    false_rate: np.ndarray   # of each language's filter

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Number of the hashed n-grams that each language's filter contains."""
        mask = self.table[slot(h, 0)]
        for k in range(1, HASHES):
            mask = mask & self.table[slot(h, k)]
        width = self.table.dtype.itemsize * 8
        return np.array([int(((mask[:, i // width] >> np.array(i % width, self.table.dtype)) & 1).sum(dtype=np.int64))
                         for i in range(len(self.languages))], dtype=np.int64)

    def predict(self, text: str | None) -> tuple:
        n, hits = 0, np.zeros(len(self.languages), dtype=np.int64)
        for h in grams(text or ""):
            n += len(h)
            hits += self.hits(h)
        if not n or not self.languages:
            return "und", 0.0
        # of n n-grams, c are of the language and (n - c) * f look as if: hits = c + (n - c) * f
        true = np.clip((hits - n * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, n)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / n)


def slot(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def held_out(id_col) -> F.Column:
    """Documents that nothing may be learnt from; a null id is one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, seed: int = SEED) -> LanguageFilters:
    """Build the filters from documents that are not held out.

    Of each language a hash sample of about ``sample_docs`` documents is
    read. An n-gram joins a language if at least MIN_DOCS of them hold it
    (one, if there is but one) and its share of them is at least DOMINANCE of
    its largest share in any language, so passages in other languages do no
    harm. N-grams are counted and turned into slots on the executors; the
    driver gets at most the table's slots. Null texts and languages are not
    learnt from; without any the filters know no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)) \
               .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}   # a row per language
    langs = sorted(n, key=lambda x: (-n[x], x))
    width = next((w for w in (8, 16, 32, 64) if len(langs) <= w), 64)
    table = np.zeros((1 << SLOT_BITS, max(-(-len(langs) // width), 1)), dtype=f"uint{width}")
    if not langs:
        return LanguageFilters([], table, np.zeros(0))
    number = F.create_map(*[F.lit(x) for i, v in enumerate(langs) for x in (v, i)])
    rate = F.create_map(*[F.lit(x) for v in langs for x in (v, min(1.0, sample_docs / n[v]))])
    sample = (rows.where(unit(seed, F.col("id").cast("string")) < F.element_at(rate, F.col("lang")))
                  .select(F.element_at(number, F.col("lang")).alias("lang"), "text"))

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                h = list(grams(text.decode("utf-8", "replace")))
                h = np.unique(np.concatenate(h)) if h else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), lang, np.int32))],
                                                 names=["gram", "lang"])

    docs_with = sample.mapInArrow(count, "gram long, lang int").groupBy("gram", "lang").agg(F.count("*").alias("n"))
    size = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    sizes = F.create_map(*[F.lit(x) for i in range(len(langs)) for x in (i, max(size.get(i, 0), 1))])
    share = F.col("n") / F.element_at(sizes, F.col("lang"))
    enough = F.col("n") >= F.least(F.lit(MIN_DOCS), F.element_at(sizes, F.col("lang")))
    per_gram = (docs_with.where(enough).withColumn("share", share).groupBy("gram")
                .agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("in")))
    member = (per_gram.select("gram", "top", F.explode("in").alias("m"))
              .where(F.col("m.share") >= F.lit(DOMINANCE) * F.col("top"))
              .select("gram", F.col("m.lang").alias("lang")))
    slots = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
                      for k in range(HASHES)])
    bit = F.expr(f"shiftleft(1L, lang % {width})")
    filled = (member.select(F.explode(slots).alias("slot"), (F.col("lang") / width).cast("int").alias("word"),
                            bit.alias("bit"))
              .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = \
        filled["bits"].to_numpy().astype(np.int64).view(np.uint64).astype(table.dtype)
    fill = np.array([((table[:, i // width] >> np.array(i % width, table.dtype)) & 1).mean() for i in range(len(langs))])
    return LanguageFilters(langs, table, fill ** HASHES)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Null texts and texts without a letter are ``und`` with score 0. A text
    with letters gets a learnt language (``und`` if none was learnt); ties go
    to the language with more training documents. ``score`` is the share of
    n-grams that are the language's. Only id and text are read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        f = shipped.value

        def run(texts):
            out = [f.predict(t.decode("utf-8", "replace") if t else None) for t in texts]
            return {"lang_pred": [p for p, _ in out], "score": [s for _, s in out]}
        return run

    return (per_text(docs, id_col, text_col, "lang_pred string, score double", make)
            .select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"))
