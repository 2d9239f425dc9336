"""Text similarity, length and completion metrics.

ROUGE-N is native: the n-grams of a row are sorted and merged within the row,
so no n-gram leaves it and a task holds one row's at a time. ROUGE-L needs an LCS, computed per
row by a bit-parallel Arrow UDF on whole texts. BERTScore takes token
vectors and is one matrix product per row, in Arrow batches.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.lcs import lcs_length
from ..functions.porter import rouge_stem
from ..functions.text import utrim, word_count


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def rouge_tokens(c) -> Column:
    """ROUGE tokenizer: lowercase, non ``[a-z0-9]`` runs to a space, split."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(toks: pd.Series) -> pd.Series:
    """Porter-stem tokens longer than 3 chars (memoised per worker)."""
    return toks.map(lambda a: None if a is None else [rouge_stem(t) for t in a])


def with_tokens(df: DataFrame, pred: str, ref: str, stem: bool = False) -> DataFrame:
    d = df.withColumn("_tp", rouge_tokens(pred)).withColumn("_tr", rouge_tokens(ref))
    if stem:
        d = d.withColumn("_tp", stem_tokens("_tp")).withColumn("_tr", stem_tokens("_tr"))
    return d


def _grams(arr: Column, n: int) -> Column:
    if n == 1:
        return arr
    idx = F.sequence(F.lit(0), F.size(arr) - n)
    return F.when(F.size(arr) >= n, F.transform(
        idx, lambda i: F.array_join(F.slice(arr, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>"))


def _f(overlap: Column, lp: Column, lr: Column) -> Column:
    """F = 2PR/(P+R) = 2*overlap/(lp+lr); 0 when nothing overlaps."""
    return F.when((overlap > 0) & (lp + lr > 0), 2.0 * overlap / (lp + lr)).otherwise(F.lit(0.0))


def rouge_n(df: DataFrame, keys, pred: str = "response", ref: str = "reference",
            ns=(1, 2), stem: bool = False, carry=()) -> DataFrame:
    """ROUGE-N F-measure per row for each n in ``ns`` (columns ``rouge{n}``).

    ``carry``: columns of the row that stay with it. Tokens that
    ``rouge_l(keep_tokens=True)`` has left are taken as they are.

    Rows of one key (and the same carried columns) count as one, with the
    n-grams of all. Plan: the texts are grouped by key, then each group's
    n-grams are sorted and the two sides merged within the row.
    """
    if {"_tp", "_tr"} <= set(df.columns):
        d = df.select(*keys, *carry, "_tp", "_tr")
    else:
        d = with_tokens(df.select(*keys, *carry, pred, ref).repartition(*keys), pred, ref, stem)
    keys = [*keys, *carry]
    d = d.groupBy(*keys).agg(F.collect_list(F.struct("_tp", "_tr")).alias("_rows"))

    def grams(side, n):
        return F.sort_array(F.flatten(F.transform("_rows", lambda r: _grams(r[side], n))))
    for n in ns:
        d = d.withColumns({f"_p{n}": grams("_tp", n), f"_r{n}": grams("_tr", n)})
    # a column of its own: the formula names the overlap twice
    d = d.withColumns({f"_ov{n}": _common(F.col(f"_p{n}"), F.col(f"_r{n}")) for n in ns})
    return d.select(*keys, *[_f(F.col(f"_ov{n}"), F.size(f"_p{n}"), F.size(f"_r{n}")).alias(f"rouge{n}") for n in ns])


def _common(a: Column, b: Column) -> Column:
    """Number of elements that two sorted arrays share, repeats counted: one
    step per element, at most, over the places in both."""
    def step(s, _):
        x, y = F.get(a, s["i"]), F.get(b, s["j"])

        def to(i, j, n):
            return F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["n"] + n).alias("n"))
        return F.when(x == y, to(1, 1, 1)).when(x < y, to(1, 0, 0)).otherwise(to(0, 1, 0))
    zero = F.lit(0)
    return F.aggregate(F.sequence(zero, F.size(a) + F.size(b)),
                       F.struct(zero.alias("i"), zero.alias("j"), zero.alias("n")), step, lambda s: s["n"])


def _lengths(lists: pa.Array) -> list:
    return pc.list_value_length(lists).fill_null(0).to_pylist()


def _numbers(*columns: pa.Array) -> list:
    """Per column its rows, each a list of tokens as numbers, equal for equal tokens."""
    flat = [c.flatten() for c in columns]
    codes = pa.concat_arrays(flat).dictionary_encode().indices.fill_null(-1).to_numpy()

    def rows(column, at):
        for n in _lengths(column):
            yield codes[at:at + n].tolist()
            at += n
    return [rows(c, sum(map(len, flat[:i]))) for i, c in enumerate(columns)]


@F.arrow_udf(T.DoubleType())
def _rouge_l_udf(tp: pa.Array, tr: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(*_numbers(tp, tr)):
        m = lcs_length(a, b)
        out.append(2.0 * m / (len(a) + len(b)) if m > 0 else 0.0)
    return pa.array(out, pa.float64())


def rouge_l(df: DataFrame, pred: str = "response", ref: str = "reference", stem: bool = False,
            out: str = "rougeL", keep_tokens: bool = False) -> DataFrame:
    """ROUGE-L F-measure (LCS over whole token sequences)."""
    d = with_tokens(df, pred, ref, stem).withColumn(out, _rouge_l_udf("_tp", "_tr"))
    return d if keep_tokens else d.drop("_tp", "_tr")


BERT = ("bert_precision", "bert_recall", "bert_f1")


def _matrices(c: pa.Array) -> list:
    """Per row a function that gives the matrix of its unit vectors; None for
    NULL or no vector."""
    vectors = c.flatten()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy()
    starts = np.r_[0, np.cumsum(np.maximum(sizes, 0))]

    def unit(a, b):
        if (sizes[a:b] != sizes[a]).any() or sizes[a] < 0:
            raise ValueError("token vectors that are NULL or of different length")
        m = values[starts[a]:starts[b]].reshape(b - a, -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    ends = np.cumsum(_lengths(c)).tolist()
    return [partial(unit, a, b) if a < b else None for a, b in zip([0, *ends], ends)]


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in BERT]))
def _bert_udf(pred: pa.Array, ref: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(_matrices(pred), _matrices(ref)):
        if a is None or b is None:
            out.append((0.0, 0.0, 0.0))
            continue
        sims = a() @ b().T
        p, r = float(sims.max(axis=1).mean()), float(sims.max(axis=0).mean())
        # as the published metric: only the undefined case (P + R = 0) becomes 0
        out.append((p, r, 2 * p * r / (p + r) if p + r != 0 else 0.0))
    columns = zip(*out) if out else [()] * len(BERT)
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in columns], list(BERT))


def bertscore(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """BERTScore by greedy matching of token vectors (double).

    P = mean over prediction tokens of the best cosine against reference
    tokens, R symmetric, F1 = 2PR/(P+R). One matrix product per row; no pair
    of tokens leaves its row. A zero vector has cosine 0 with everything; a
    side that is NULL or has no token scores 0.
    """
    return df.withColumn("_b", _bert_udf(pred, ref)).select(*df.columns, "_b.*")


def task_completion(c) -> Column:
    """0 if stripped length < 5, 0.5 if more than 1000 words, else 1."""
    x = _col(c)
    return (F.when(x.isNull() | (F.length(utrim(x)) < 5), F.lit(0.0))
             .when(word_count(x) > 1000, F.lit(0.5)).otherwise(F.lit(1.0)))


def length_band(c, low: int = 20, high: int = 150) -> Column:
    """Collapse (< low words), runaway (> high words) or normal."""
    n = word_count(c)
    return F.when(n < low, "collapse").when(n > high, "runaway").otherwise("normal")
