"""Ranked search, language-model scores and hard negatives against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneval.llm import gru, hard_negatives, ranked_search, recurrent_lm
from tuneval.llm.common import configure, read

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta " * 30_000 + "omega"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------ ranked search
def plain_search(docs, items, k=10):
    d = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    d = [(i, c, c.total()) for i, c in d if c]
    n_docs, n_terms = len(d), sum(n for *_, n in d)
    df = Counter(w for _, c, _ in d for w in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        q = Counter(TERM.findall(lower(text)))
        found = []
        for i, c, n in d:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) *
                    (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, r in q.items() if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    docs, items = read(configure(spark), SF, "documents"), read(spark, SF, "benchmark")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    for size in (ranked_search.BLOCK_CHARS, 3000):
        got = ranked_search.search(docs, items, block_chars=size)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_edge_rows(spark):
    configure(spark)
    docs = [(1, "Red apple, red APPLE."), (2, None), (3, ""), (4, " ,. "), (None, "red apple red apple"), (5, LONG),
            (6, "red apple red apple"), (6, "red apple red apple"), (7, "été Été 中文字 ＡＢ"), (8, "red")]
    items = [(1, "RED apple"), (1, "RED apple"), (1, "omega"), (2, None), (3, ""), (None, "中文字 été"), (4, "nowhere"),
             (5, " ".join(["gamma"] * 400_000))]
    d = spark.createDataFrame([(*x, "x", 1, 2, 3) for x in docs],
                              "doc_id long, text string, item_id string, score int, n int, ids int")
    q = spark.createDataFrame([(*x, 1, "r") for x in items], "item_id long, text string, doc_id int, rank string")
    got = sorted(map(tuple, ranked_search.search(d, q, k=4).collect()), key=str)
    assert got == plain_search(docs, items, 4)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[:1] == (1,) and r[3] != got[0][3]][:1]
    for x, y in ((d.where("false"), q), (d, q.where("false"))):
        e = ranked_search.search(x, y)
        assert e.count() == 0 and e.columns == ["item_id", "rank", "doc_id", "score"]


def test_products_are_exact():
    """Sums beyond 2^53 are cut into tiles; a single weight beyond it is multiplied as an integer."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10**6, (5, 3000)).astype(float)
    w = rng.integers(0, 10**9, (3000, 7)).astype(float)
    w[17, 3] = 10**11 + 1
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in w.T] for r in x]
    assert ranked_search.product(x, w).tolist() == want


# ---------------------------------------------------------- language model
def plain_states(p, hidden, inputs):
    def sig(x):
        return 1 / (1 + np.exp(-x))
    h, out = np.zeros(hidden), []
    for i in inputs:
        g, u = p["table"][i].astype(float), h @ p["u"].astype(float)
        z, r = sig(g[:hidden] + u[:hidden]), sig(g[hidden:2 * hidden] + u[hidden:2 * hidden])
        new = np.tanh(g[2 * hidden:] + r * u[2 * hidden:])
        h = (1 - z) * new + z * h
        out.append(h)
    return out


def plain_log(layout, flat, hidden, doc):
    """Log probability of one document, step by step."""
    p, total = gru.views(flat, layout, hidden), 0.0
    for h, t in zip(plain_states(p, hidden, [layout.words + 1, *doc[:-1]]), doc):
        a = h @ p["class_w"] + p["class_b"]
        c = layout.of[t]
        total += a[c] - np.log(np.exp(a).sum())
        if c < layout.classes:
            lo, hi = layout.bounds[c], layout.bounds[c + 1]
            b = h @ p["word_w"][:, lo:hi] + p["word_b"][lo:hi]
            total += b[t - lo] - np.log(np.exp(b).sum())
    return total


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    layout, hidden = gru.Layout(np.array([50, 30, 20, 10, 5, 4, 3, 2, 1, 1]), 12, classes=4), 5
    flat = layout.start(hidden) + rng.normal(0, 0.3, gru.size(layout, hidden)).astype(np.float32)
    docs = [rng.integers(0, layout.words + 1, n).astype(np.int32) for n in (1, 7, 90, 40, 3, 150, 1, 33)]
    return layout, hidden, flat, docs


def test_state_is_carried_through_whole_documents(small):
    layout, hidden, flat, docs = small
    want = [plain_log(layout, flat, hidden, d) for d in docs]
    for slots, window in ((8, 16), (2, 7), (1, 1000), (3, 1)):
        assert np.allclose(gru.log_likelihoods(layout, flat, docs, hidden, slots, window), want, rtol=1e-4)


def test_probabilities_sum_to_one(small):
    layout, hidden, flat, _ = small
    total = [sum(np.exp(plain_log(layout, flat, hidden, [3, 1, t]) - plain_log(layout, flat, hidden, [3, 1]))
                 for t in range(layout.words + 1))]
    got = gru.log_likelihoods(layout, flat, [np.array([3, 1, t]) for t in range(layout.words + 1)], hidden)
    one = gru.log_likelihoods(layout, flat, [np.array([3, 1])], hidden)[0]
    assert np.isclose(total[0], 1) and np.isclose(np.exp(got - one).sum(), 1, rtol=1e-4)


def test_gradients_by_differences(small):
    layout, hidden, flat, docs = small
    flat = flat.astype(np.float64)
    laid = gru.Slots(docs, layout.words, 3)
    inputs, target, doc = list(laid.windows(20))[1]
    h = np.random.default_rng(1).normal(0, 0.5, (hidden, inputs.shape[1]))

    def value(x):
        model = gru.Model(layout, x, hidden)
        s = model.states(inputs, h)
        on = doc.ravel() >= 0
        return model.logs(model.rows(s["after"])[on], target.ravel()[on])[0].sum()
    _, grad, _ = gru.Model(layout, flat, hidden).gradient(inputs, target, doc >= 0, h)
    whole = np.zeros_like(flat)
    v = gru.views(whole, layout, hidden)
    for name, g in grad.items():
        if name == "table":
            v[name][g[0]] = g[1]
        else:
            v[name][:] = g
    rng = np.random.default_rng(2)
    for k in rng.choice(len(flat), 120, replace=False):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert np.isclose((value(flat + step) - value(flat - step)) / 2e-5, whole[k], rtol=1e-3, atol=1e-5)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def check_base(rows, docs, held):
    c = Counter(w for i, t in docs if not held(i) for w in (*words_of(t), None))
    n, v = c.total(), len(c)
    by = {}
    for i, t in docs:
        w = (*words_of(t), None)
        by.setdefault(i, []).append((len(w), sum(c[x] > 0 for x in w), n,
                                     sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id)
        assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and math.isclose(r.base_score, w[3], rel_tol=1e-9,
                                                                                       abs_tol=1e-9)
                   for w in by[r.doc_id])


def test_base_score_and_held_out_documents(spark, monkeypatch):
    docs = read(configure(spark), SF, "documents").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(recurrent_lm, "HEAD_SHARE", 500)       # most words take the join
    for head_bytes in (64, 4):
        monkeypatch.setattr(recurrent_lm, "HEAD_BYTES", head_bytes)
        rows = recurrent_lm.score(docs, held, words=200).collect()
        check_base(rows, plain, lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
        out = [r for r in rows if r.held_out]
        assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_edge_rows(spark):
    configure(spark)
    texts = [(1, "One two two three."), (2, None), (3, ""), (4, " \t\n "), (None, "words of a text without id"), (5, LONG),
             (6, "One two"), (6, "One two"), (7, "wörd " * 50 + "x" * 500)]
    d = spark.createDataFrame([(*t, "p", 1, 2.0, "r") for t in texts],
                              "doc_id long, text string, part string, pos int, score double, word string")
    held = F.col("doc_id").isin(1, 7)
    r = recurrent_lm.score(d, held).collect()
    check_base(r, texts, lambda i: i is None or i in (1, 7))
    by = {x.doc_id: x for x in r}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[2].score == by[3].score
    assert all(math.isfinite(x.score) and x.score <= 0 for x in r)
    assert len({(x.score, x.base_score) for x in r if x.doc_id == 6}) == 1
    none = recurrent_lm.score(d, F.lit(True)).collect()
    assert len(none) == len(texts) and all(x.score == x.base_score == 0 and x.train_tokens == 0 for x in none)
    assert recurrent_lm.score(d.where("false"), held).count() == 0


# ----------------------------------------------------------- hard negatives
def plain_negatives(rows, anchor, positives=5, negatives=3):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in (r for r in ok if anchor(r[0])):
        s = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in ok if len(b[2]) == len(a[2])]
        for ps, p, _ in sorted(x for x in s if x[2] == a[1] and x[1] != a[0])[:positives]:
            fit = sorted(x for x in s if x[2] != a[1] and 50 * -ps <= 100 * -x[0] <= 95 * -ps)
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def test_negatives_against_brute_force(spark):
    configure(spark)
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 0.2) + (i % 4 == 0) for _ in range(6)]) for i in range(600)]
    rows += [(i, 1, rows[7][2]) for i in range(600, 700)]                 # many equal vectors
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in d.collect()]
    for size in (hard_negatives.BLOCK_BYTES, 500):
        got = hard_negatives.mine(d, F.col("vec_id") % 20 == 0, block_bytes=size).collect()
        assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_edge_rows(spark):
    configure(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [0.5, 2.0]), (3, 2, [1.0, 1.0]), (4, 2, [0.9, 1.5]),
            (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]),
            (None, 2, [1.0, 1.0]), (10, 2, [1.0, 1.0]), (10, 2, [1.0, 1.0]), (50, 3, []), (51, 3, []), (52, 4, []),
            (100, 5, [0.0, 0.0]), (101, 5, [1.0, 1.0]), (150, 6, [1e7, 1.0]), (151, 6, [1e7, 2.0]), (152, 7, [9e6, 5.0]),
            (200, 8, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows],
                              "vec_id long, label int, embedding array<double>, id int, v int, anchor string, grp int")
    got = hard_negatives.mine(d, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 50 == 0)
    for e in (d.where("false"), d.where("vec_id = 1")):
        assert hard_negatives.mine(e, F.col("vec_id") % 50 == 0).count() == 0


def test_walks_end_early():
    """The bounds hold for every pair and let a member leave before the list's end."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3)).round(2) * 256 // 1
    c = hard_negatives.Cluster(np.arange(20), np.arange(20), np.zeros(20), x[:20] + 2000)
    norm, unit = hard_negatives.directions(x)
    bound = c.bounds(norm, unit)
    assert ((c.x @ x.T) <= c.norm[:, None] * bound + 1).all()
    seen = []
    hard_negatives.walk(c, norm, unit, x, np.arange(400), np.zeros(400),
                        lambda m: np.full(len(m), np.quantile(c.x @ x.T, 0.99)),
                        lambda m, s, i, lab: seen.append(s.size))
    assert sum(seen) <= 20 * 400 and hard_negatives.STEP >= 400 or sum(seen) < 20 * 400
