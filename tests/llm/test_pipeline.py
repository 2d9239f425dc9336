"""The pipeline's rows against a plain version of its five stages."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from test_brute import levenshtein_search, plain_counts, plain_fingerprint, reach
from tuneval.llm import decontaminate, quality_rules
from tuneval.llm.common import configure, read

SF = "/root/testdata/sf0.001"


def plain(spark):
    docs = [r.asDict() for r in read(spark, SF, "documents").collect()]
    # quality: base rule by plain counts, verdict of the trained model
    model = quality_rules.train(read(spark, SF, "documents"), read(spark, SF, "labels"))
    feats = quality_rules.Features()

    def good(t):
        n, _, _, _, rep = plain_counts(t)
        if n < 50 or 100 * rep > 50 * n:
            return False
        return model.probability(model.margin(feats, t.encode().split(), t.encode())) >= 0.5
    docs = [d for d in docs if good(d["text"])]
    # near duplicates: all pairs
    fp = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    ids = sorted(fp)
    root = reach(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 3])
    docs = [d for d in docs if root[d["doc_id"]] == d["doc_id"]]
    # benchmark items: edit distance to every document
    items = [i for r in read(spark, SF, "benchmark").collect() if (i := decontaminate.item_of(r.item_id, r.text))]

    def held(t):
        t = decontaminate.normal(t)
        return any(i.text in t or (set(i.text.split()) & set(t.split()) and len(t) < 3000
                                   and levenshtein_search(i.text, t) <= i.budget) for i in items)
    docs = [d for d in docs if not held(d["text"])]
    # mixing
    size = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    src = sorted({d["source"] for d in docs})
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in src}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(src)}
    full = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in src if s not in full)
        more = {s for s in src if weight[s] * level > 2 * total[s]}
        if more == full:
            break
        full = more
    out = []
    for d in docs:
        rate = min(2 * total[d["source"]], weight[d["source"]] * level) / total[d["source"]]
        key = f"42:{d['doc_id']}:{hashlib.md5(d['text'].encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52
        out += [d] * (int(rate) + (u < rate - int(rate)))
    # tokens
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start = [], 0
    for d in sorted(out, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"], add_special_tokens=False).ids, 1]
        rows.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return rows


def test_pipeline_rows(spark):
    configure(spark)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.run(spark, SF).collect())
    assert got == sorted(plain(spark))
    assert len(got) > 100


def test_stages(spark):
    configure(spark)
    docs = read(spark, SF, "documents")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination",
                                        "mix_sources", "token_files"]
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    for name, stage in C.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
