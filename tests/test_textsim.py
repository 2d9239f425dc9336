"""ROUGE, LCS, stemmer and BERTScore against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tuneval.functions.lcs import lcs_length
from tuneval.functions.porter import stem
from tuneval.operators import textsim


def toks(s):
    return [t for t in re.sub(r"[^a-z0-9]+", " ", s.lower()).split(" ") if t]


def rouge_n_ref(p, r, n):
    gp = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
    gr = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
    ov = sum((gp & gr).values())
    lp, lr = sum(gp.values()), sum(gr.values())
    return 0.0 if ov == 0 else 2 * ov / (lp + lr)


def lcs_dp(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


TEXTS = [("The cat sat on the mat.", "A cat sat on a mat!"), ("", "x y"), ("", ""),
         ("one two three two one", "two one two three"), ("Ça va? Très bien", "ca va tres bien"),
         ("the the the", "the")]


def test_rouge_n_matches_brute_force(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEXTS)],
                               "id int, response string, reference string")
    got = {r.id: (r.rouge1, r.rouge2) for r in textsim.rouge_n(df, ["id"]).collect()}
    for i, (a, b) in enumerate(TEXTS):
        assert got[i][0] == pytest.approx(rouge_n_ref(toks(a), toks(b), 1))
        assert got[i][1] == pytest.approx(rouge_n_ref(toks(a), toks(b), 2))


def test_rouge_identity_and_symmetry(spark):
    df = spark.createDataFrame([(0, "a b c d", "a b c d"), (1, "a b x", "x a b"),
                                (2, "x a b", "a b x")], "id int, response string, reference string")
    got = {r.id: r for r in textsim.rouge_n(df, ["id"]).collect()}
    assert got[0].rouge1 == 1.0 and got[0].rouge2 == 1.0
    assert got[1].rouge1 == got[2].rouge1 and got[1].rouge2 == got[2].rouge2
    rl = {r.id: r.rougeL for r in textsim.rouge_l(df).collect()}
    assert rl[0] == 1.0 and rl[1] == rl[2]


def test_rouge_l_matches_dp(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(40):
        a = " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 25)))
        b = " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 25)))
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id int, response string, reference string")
    got = {r.id: r.rougeL for r in textsim.rouge_l(df).collect()}
    for i, a, b in rows:
        ta, tb = toks(a), toks(b)
        m = lcs_dp(ta, tb)
        assert got[i] == pytest.approx(0.0 if m == 0 else 2 * m / (len(ta) + len(tb)))


def test_lcs_long_text_is_whole():
    a = ["w%d" % (i % 97) for i in range(20000)]
    b = ["w%d" % (i % 89) for i in range(20000)]
    assert lcs_length(a, b) > 0
    assert lcs_length(a[:300], b[:300]) == lcs_dp(a[:300], b[:300])


# Full-algorithm outputs of the published Porter stemmer.
PORTER = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed",
          "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
          "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
          "relational": "relat", "generalizations": "gener", "oscillators": "oscil",
          "adjustment": "adjust", "adoption": "adopt", "controll": "control", "roll": "roll"}


# Where the extended rules differ, from their public description.
EXTENDED = {"enjoy": "enjoy", "dies": "die", "dying": "die", "died": "die", "flies": "fli", "skies": "sky",
            "possibly": "possibl", "happy": "happi", "spied": "spi", "news": "news", "innings": "inning",
            "proceed": "proceed", "say": "say", "geology": "geolog", "hopefully": "hope"}


def test_porter_vectors():
    assert {w: stem(w, extended=False) for w in PORTER} == PORTER
    assert {w: stem(w) for w in PORTER} == PORTER
    assert {w: stem(w) for w in EXTENDED} == EXTENDED
    assert stem("enjoy", extended=False) == "enjoi" and stem("dies", extended=False) == "di"


def test_bertscore_of_nothing_is_zero(spark):
    rows = [(1, [], [[1.0, 0.0]]), (2, None, [[1.0, 0.0]]), (3, [[0.0, 0.0]], [[1.0, 0.0]]), (4, [], []),
            (5, [[0.0, 0.0], [2.0, 0.0]], [[1.0, 0.0]])]
    df = spark.createDataFrame(rows, "pair_id int, pred array<array<double>>, ref array<array<double>>")
    got = {r.pair_id: (r.bert_precision, r.bert_recall, r.bert_f1) for r in textsim.bertscore(df).collect()}
    assert all(got[i] == (0.0, 0.0, 0.0) for i in (1, 2, 3, 4))
    assert got[5] == pytest.approx((0.5, 1.0, 2 / 3))


def test_bertscore_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(5):
        p = rnd.normal(size=(rnd.integers(1, 6), 8))
        r = rnd.normal(size=(rnd.integers(1, 6), 8))
        rows.append((i, p.tolist(), r.tolist()))
    df = spark.createDataFrame(rows, "pair_id int, pred array<array<double>>, ref array<array<double>>")
    got = {r.pair_id: r for r in textsim.bertscore(df).collect()}
    for i, p, r in rows:
        p, r = np.array(p), np.array(r)
        sim = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
        P, R = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        assert got[i].bert_precision == pytest.approx(P)
        assert got[i].bert_recall == pytest.approx(R)
        assert got[i].bert_f1 == pytest.approx(2 * P * R / (P + R))


def test_task_completion_and_bands(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("   hi  ",), ("hello world",), (" ".join(["w"] * 1001),)], "x string")
    out = df.select(textsim.task_completion("x").alias("c"), textsim.length_band("x").alias("b")).collect()
    assert [r.c for r in out] == [0.0, 1.0, 0.5]
    assert [r.b for r in out] == ["collapse", "collapse", "runaway"]
    assert F is not None
