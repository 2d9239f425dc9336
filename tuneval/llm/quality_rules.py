"""Quality rules: counts of a text, and a hashed n-gram logistic regression.

Base counts come from the whole text. The verdict is a logistic regression
on hashed word 1-2-grams and character 3-grams, trained on labelled quality
rows, calibrated on rows it was not trained on, and compared with a fixed
threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, per_text, unit
from .ngrams import WordHashes, char_grams, codepoints, pieces, word_grams

SEED = 42
BUCKETS = 1 << 16          # of words, and as many of characters
CHAR_N = 3
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
LABELLED_ROWS = 3000       # expected size of the hash sample that is learnt from
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long")
FIELDS = COUNTS + ", base_failed boolean, quality double, kept boolean"


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    n = end = 0
    for i, w in enumerate(windows):
        if w in again:
            n += i + 3 - max(end, i)
            end = i + 3
    return n


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(text: bytes | None) -> tuple:
    """(words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or b""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return words, len(words), chars, symbols, dup_lines(text), repeat_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PCT * n_words


class Features:
    """Bucket numbers of a text's n-grams: words below BUCKETS, characters above."""

    def __init__(self):
        self.hashes = WordHashes()

    def words(self, words: list) -> np.ndarray:
        h = self.hashes.of(words)
        return np.concatenate([(word_grams(h, n) >> np.uint64(48)).astype(np.int32) for n in (1, 2)])

    def chars(self, text: bytes):
        cp = codepoints(text.decode("utf-8", "replace"))
        for p in pieces(cp, CHAR_N):
            yield (char_grams(p, CHAR_N) >> np.uint64(48)).astype(np.int32)

    def frequencies(self, text: bytes) -> tuple:
        """(bucket, share) pairs: shares of the word grams, then of the character grams."""
        w = np.bincount(self.words(text.split()), minlength=BUCKETS)
        c = sum((np.bincount(x, minlength=BUCKETS) for x in self.chars(text)),
                np.zeros(BUCKETS, dtype=np.int64))
        x = np.concatenate([w / max(w.sum(), 1), c / max(c.sum(), 1)])
        at = np.flatnonzero(x)
        return at.astype(np.int32), x[at].astype(np.float32)


@dataclass
class QualityModel:
    """P(quality = 1) = sigmoid(slope * margin + offset); the margin is the
    mean weight of the word grams plus that of the character grams."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, feats: Features, words: list, text: bytes) -> float:
        z, w = self.bias, feats.words(words)
        if len(w):
            z += float(self.weights[:BUCKETS][w].mean())
        total = n = 0
        for c in feats.chars(text):
            total, n = total + float(self.weights[BUCKETS:][c].sum()), n + len(c)
        return z + (total / n if n else 0.0)

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(at: list, share: list, y: np.ndarray, steps: int = 120, l2: float = 1e-6,
        rate: float = 2.0) -> tuple:
    """Logistic regression on sparse rows by full-batch Adam -> (weights, bias).

    Classes weigh alike, whatever their share of the rows.
    """
    lens = np.array([len(a) for a in at])
    rows = np.repeat(np.arange(len(at)), lens)
    cols = np.concatenate(at) if len(at) else np.empty(0, np.int32)
    vals = np.concatenate(share).astype(np.float64) if len(at) else np.empty(0)
    cw = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, b = np.zeros(2 * BUCKETS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], minlength=len(at)) + b
        e = cw * (_sigmoid(z) - y)
        g = np.bincount(cols, vals * e[rows], minlength=len(w)) + l2 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple:
    """Platt scaling of margins -> (slope, offset), targets smoothed by class size."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = z.std() or 1.0
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * x + b)
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).mean(), (p - t).mean()])
        hess = np.array([[(h * x * x).mean() + 1e-6, (h * x).mean()], [(h * x).mean(), h.mean() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return a / scale, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = LABELLED_ROWS, seed: int = SEED) -> QualityModel | None:
    """Learn from a hash sample of about ``rows`` labelled documents.

    Documents labelled twice count as bad if any label is. One row in four is
    left out of the regression and calibrates it. Without both classes among
    the labelled rows there is no model (None). ``rows`` bounds what is
    broadcast (the sampled ids) and what the driver receives (sparse vectors).
    """
    lab = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
                 .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y")))
    n = lab.count()
    if not n:
        return None
    picked = lab.where(unit(seed, F.col("__id")) < min(1.0, rows / n))
    src = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
               .join(F.broadcast(picked), "__id")
               .select(F.concat_ws(":", F.col("__id").cast("string"), F.col("__y").cast("string")).alias("key"),
                       "text"))

    def make():
        feats = Features()

        def run(texts):
            out = [feats.frequencies(t or b"") for t in texts]
            return {"at": [a.tobytes() for a, _ in out], "share": [s.tobytes() for _, s in out]}
        return run

    got = per_text(src, "key", "text", "at binary, share binary", make).toArrow().sort_by("doc_id").to_pydict()
    keys = got["doc_id"]
    y = np.array([int(k.rpartition(":")[2]) for k in keys], dtype=np.float64)
    at = [np.frombuffer(b, np.int32) for b in got["at"]]
    share = [np.frombuffer(b, np.float32) for b in got["share"]]
    if len(set(y)) < 2:
        return None
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[3::4]] = True
    w, b = fit([a for a, h in zip(at, held) if not h], [s for s, h in zip(share, held) if not h], y[~held])
    z = np.array([float(w[a] @ s) for a, s in zip(at, share)]) + b
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    slope, offset = calibrate(z[use], y[use])
    return QualityModel(w.astype(np.float32), float(b), float(slope), float(offset))


def _scorer(model):
    def make():
        feats = Features()

        def run(texts):
            rows = []
            for t in texts:
                words, *counts = base_counts(t)
                failed = base_failed(counts[0], counts[4])
                p = None
                if model.value is not None:
                    p = model.value.probability(model.value.margin(feats, words, t or b""))
                rows.append((*counts, failed, p, not failed and (p is None or p >= THRESHOLD)))
            names = [f.split()[0] for f in FIELDS.split(", ")]
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
        return run
    return make


def quality_rules(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, quality, kept.

    Null and empty texts have no words and fail the base rule. Without a
    model ``quality`` is null and the base rule alone decides. Repeated rows
    get equal rows; other input columns are not read.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, id_col, text_col, FIELDS, _scorer(m))


def keep_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, with all their columns."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    make = _scorer(m)
    return keep_rows(docs, text_col, lambda: (lambda run: lambda texts: run(texts)["kept"])(make()))
