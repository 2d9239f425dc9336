"""Shortcuts, caches and long texts of the token and line operators."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tuneval.llm import line_dedup, quality_rules, token_counts, token_files
from tuneval.llm.common import configure
from tuneval.llm.ngrams import WordHashes
from tuneval.llm.vocab import Remembered, read_spec

TEXTS = ["it’s a “quoted” word — and 5 € more", "日本語のテキストです。 中文 文本", "naïve café über", "плохо, хорошо"]


def test_shortcut_is_asked_for_every_text():
    spec = read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(spec)
    for text in TEXTS:
        c = token_counts.Counter(spec, token_counts.prove(spec))
        assert c.count(text) == len(tok.encode(text, add_special_tokens=False).ids)
        assert c.matched > 0                      # some pre-token of each is proven
        assert c.matched + c.merged == len(c.known) + len(c.known_mapped)
    c = token_counts.Counter(spec, token_counts.prove(spec))
    assert c.count(TEXTS[0]) and c.merged < c.matched


def test_other_tokenizers_are_errors(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="normalizer"):
        token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="pre-tokenizer"):
        token_files.check_spec(read_spec(public_tokenizers.path("byte_bpe_50k.json")))


def test_caches_hold_no_long_keys():
    h, r, long = WordHashes(), Remembered(len, 10), b"x" * 1000
    assert h[long] == h[long] and len(h) == 0 and h[b"a"] and len(h) == 1
    assert r[long] == 1000 and len(r) == 0
    t = token_files.IdTable(lambda keys: ([1] * len(keys), list(range(len(keys)))), 5000)
    for k in range(50):
        n, _ = t.take([f"{k}-{i}" for i in range(20)])
        assert list(n) == [1] * 20 and t.size <= 5000 + 20 * 110


def test_invalid_utf8_counts_as_replaced(spark):
    configure(spark)
    docs = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.expr("cast(X'61FF6220E4' as string)").alias("text"))
    r = quality_rules.quality_rules(docs, None).first()
    assert (r.n_words, r.word_chars) == (2, 4)


def test_lines_of_very_long_texts(spark):
    """100,000 lines, every other one boilerplate; cost grows with the lines."""
    configure(spark)

    def run(n):
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(
            F.when(i % 2 == 0, "common ").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))),
            F.lit(" "), i.cast("string"))), "\n")
        docs = spark.range(3).select(F.col("id").alias("doc_id"), text.alias("text"),
                                     F.col("id").cast("string").alias("source"))
        t = time.time()
        rows = line_dedup.remove_boilerplate(docs, min_sites=3).collect()
        return rows, time.time() - t
    run(100)
    _, short = run(5_000)
    rows, long = run(100_000)
    for r in rows:
        assert (r.n_lines, r.n_removed) == (100_000, 50_000)
        assert r.text == "\n".join(f"own {r.doc_id} {i}" for i in range(1, 100_000, 2))
    assert long < 20 * short + 10
