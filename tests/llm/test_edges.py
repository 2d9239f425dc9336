"""Defined results on nulls, empty and very long texts, ties, repeated rows,
empty tables and extra columns whose names clash with an operator's own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tuneval.llm import (decontaminate, importance, language, line_dedup, mixing, quality_rules, simhash,
                         surrogates, token_counts, token_files)
from tuneval.llm.common import configure, scratch_path

LONG = "alpha beta gamma delta " * 30_000 + "omega"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, copies int, "
          "fp long, site string, line long, key string, part int, ids string, score double, quality int, id string")
EXTRA = (1, False, 7, 3, 5, "x", 9, "k", 2, "i", 0.5, 1, "y")


def rows():
    texts = [(1, "One two three four five six.\nSame line here.", "en", "a"), (2, None, None, None), (3, "", "en", "b"),
             (4, " \t\n ", "fr", "a"), (None, "No id but words of its own here.", "en", "a"),
             (5, LONG, "en", None), (6, "One two three four five six.\nSame line here.", "en", "b"),
             (6, "One two three four five six.\nSame line here.", "en", "b"), (7, "123 456 !!", "de", "c")]
    return [(*t, *EXTRA) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    configure(spark)
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (3, None, None), (6, 1, 1), (6, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "ONE two,three four five six"), (2, None), (None, "no id but words of its own"),
                                  (4, "six"), (5, "one two three four five six")], "item_id long, text string")


def operators(spark, docs, labels, bench):
    path = scratch_path(spark, "edge-tokens")

    def files(d):
        token_files.write_tokens(d, path, public_tokenizers.path("word_bpe_49k.json"))
        return token_files.digests(token_files.read_tokens(spark, path))

    def resampled(d):
        target, share = importance.target_documents(d, labels)
        return importance.resample(d, importance.log_ratio(d, target), share)

    return {
        "language": lambda d: language.identify(d, language.train(d)),
        "quality": lambda d: quality_rules.quality_rules(d, quality_rules.train(d, labels)),
        "pii": lambda d: surrogates.replace_pii(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "counts": lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "files": files,
        "mixing": lambda d: mixing.mix_plan(d),
        "resampling": resampled,
        "lines": lambda d: line_dedup.remove_boilerplate(d, min_sites=2),
        "keep_quality": lambda d: quality_rules.keep_quality(d, quality_rules.train(d, labels)),
        "keep_one": lambda d: simhash.keep_one(d),
        "keep_clean": lambda d: decontaminate.keep_clean(d, bench),
        "mix": lambda d: mixing.mix(d),
        "contamination": lambda d: decontaminate.contamination(d, bench),
    }


PER_ROW = ("language", "quality", "pii", "simhash", "counts", "files", "mixing", "resampling", "lines")
SAME_COLUMNS = ("keep_quality", "keep_one", "keep_clean", "mix")


@pytest.mark.parametrize("name", (*PER_ROW, *SAME_COLUMNS, "contamination"))
def test_edge_rows_and_empty_table(spark, docs, labels, bench, name):
    run = operators(spark, docs, labels, bench)[name]
    df = run(docs)
    got = df.collect()
    if name in PER_ROW:
        assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in rows())
        assert len({tuple(map(str, (r[c] for c in r.asDict() if c != "start"))) for r in got if r.doc_id == 6}) == 1
    if name in SAME_COLUMNS:
        assert df.columns == docs.columns
        assert all(tuple(r)[4:] == EXTRA for r in got)
    empty = run(docs.where("false"))
    assert empty.count() == 0
    assert empty.columns == df.columns


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_values(spark, docs, labels, bench):
    r = by_id(operators(spark, docs, labels, bench)["language"](docs))
    assert [r[i].lang_pred for i in (2, 3, 4, 7)] == ["und"] * 4 and r[None].held_out
    assert r[2].score == 0.0 and 0 <= r[5].score <= 1


def test_quality_values(spark, docs, labels, bench):
    r = by_id(operators(spark, docs, labels, bench)["quality"](docs))
    assert r[2].n_words == r[3].n_words == r[4].n_words == 0 and r[2].base_failed and not r[2].kept
    assert r[5].n_words == 120_001 and r[5].n_repeat_words == 120_000 and r[5].base_failed


def test_simhash_values(spark, docs, labels, bench):
    r = by_id(operators(spark, docs, labels, bench)["simhash"](docs))
    assert {r[i].fingerprint for i in (2, 3, 4)} == {"0" * 16} and {r[i].component_id for i in (2, 3, 4)} == {2}
    assert r[6].component_id == 1 and r[None].component_id is None
    kept = operators(spark, docs, labels, bench)["keep_one"](docs).collect()
    assert sorted(k.doc_id or -1 for k in kept) == [-1, 1, 2, 5, 7]


def test_repeated_rows_keep_one(spark, docs):
    twice = docs.where("doc_id = 6")
    assert simhash.keep_one(twice).count() == 1
    nulls = docs.where("doc_id is null").unionByName(docs.where("doc_id is null"))
    assert simhash.keep_one(nulls).count() == 1


def test_mixing_values(spark, docs, labels, bench):
    plan = mixing.mix_plan(docs)
    assert [c for c in plan.columns if c.lower() == "size"] == ["size"]
    r = by_id(plan)
    assert r[2]["size"] == 0 and r[2].taken == 0 and r[2].source_size == r[5].source_size == 120_001
    n = plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs).count() == n


def test_lines_and_files_values(spark, docs, labels, bench):
    ops = operators(spark, docs, labels, bench)
    r = by_id(ops["lines"](docs))
    assert r[2].text is None and r[3].text == "" and r[2].n_lines == 0
    assert r[1].n_removed == 2 and r[1].text == ""       # both lines stand on sites a and b
    assert r[4].text == " \t\n " and r[5].n_lines == 1
    f = by_id(ops["files"](docs))
    assert f[2].n_tokens == f[3].n_tokens == 1 and f[None].start == 0


def test_contamination_values(spark, docs, bench):
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 5), (6, 1), (6, 1), (6, 5), (6, 5)]
    assert all(r.distance == 0 for r in got)
    kept = decontaminate.keep_clean(docs, bench).collect()
    assert sorted(k.doc_id or -1 for k in kept) == [-1, 2, 3, 4, 5, 7]
    blocks = decontaminate.contamination(docs, bench, block_chars=10).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_pii_values(spark, docs):
    r = by_id(surrogates.replace_pii(docs))
    assert r[2].text is None and r[3].text == "" and r[5].text == LONG and r[5].n_entities == 0


def test_no_labels(spark, docs, labels):
    assert quality_rules.train(docs, labels.where("false")) is None
    one_class = quality_rules.train(docs, labels.where("quality = 1"))
    assert one_class is None
    r = by_id(quality_rules.quality_rules(docs, None))
    assert r[1].quality is None and not r[1].kept
    target, share = importance.target_documents(docs, labels.where("false"))
    assert share == 1.0 and all(x.kept for x in importance.resample(
        docs, importance.log_ratio(docs, target), share).collect())
