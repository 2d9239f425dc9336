"""Projection, normalisation and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import jsonfn as J
from ..functions.text import or_empty, strip_prompt_echo, truncate, utrim
from ..session import checkpoint_dir
from .ranking import top_k, with_smallest

RECORD_FIELDS = ("instruction", "input", "output")


def normalize_records(df: DataFrame, keys=("prompt_id",), fields=RECORD_FIELDS) -> DataFrame:
    """B1+B2+B3: missing fields -> '', input stripped, other columns pruned."""
    cols = [F.col(k) for k in keys]
    for f in fields:
        c = F.col(f) if f in df.columns else F.lit(None).cast("string")
        cols.append((utrim(c) if f == "input" else or_empty(c)).alias(f))
    return df.select(*cols)


def prefix_take(df: DataFrame, n: int, by=("checkpoint",), order=("prompt_id",)) -> DataFrame:
    """First ``n`` rows per group in id order."""
    return top_k(df, list(by), list(order), n)


def fraction_prefix(df: DataFrame, frac: float, by=("checkpoint",),
                    order=("prompt_id",)) -> DataFrame:
    """First ``int(n*frac)`` rows per group (all rows when frac >= 1) in the
    order of a numeric id; further ``order`` columns break ties."""
    if frac >= 1.0:
        return df
    key, *ties = order
    return with_smallest(df, key, lambda n: F.floor(n * F.lit(float(frac))), by, ties, flag="_in") \
        .where("_in").drop("_in")


def split_valid(df: DataFrame, col: str = "output"):
    """(kept, rejected) by strict JSON validity of a non-empty value.

    The flag is materialised, so that neither filter is pushed into the parse
    and the texts are parsed once for both outputs.
    """
    checkpoint_dir(df.sparkSession)
    ok = F.coalesce((F.col(col) != "") & J.strict_valid(col), F.lit(False))
    d = df.withColumn("_ok", ok).checkpoint()
    return d.where("_ok").drop("_ok"), d.where(~F.col("_ok")).drop("_ok")


# Sentinel responses the generator writes instead of text.
NO_OUTPUT = "[no output]"
ERROR_PREFIX = "[error:"


def response_status(df: DataFrame, response: str = "response", short_min: int | None = None,
                    out: str = "response_status") -> DataFrame:
    """B7 (+B8 when ``short_min`` is set): ok / no_output / error / missing."""
    r = F.col(response)
    st = (F.when(r.isNull(), F.lit("missing"))
           .when(r == NO_OUTPUT, F.lit("no_output"))
           .when(r.startswith(ERROR_PREFIX), F.lit("error")))
    if short_min is not None:
        st = st.when(F.length(utrim(r)) < short_min, F.lit("no_output"))
    return df.withColumn(out, st.otherwise(F.lit("ok")))


def truncate_text(df: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """B9."""
    return df.withColumn(out or col, truncate(col, n))


def remove_prompt_echo(df: DataFrame, full: str, prompt: str, out: str = "response") -> DataFrame:
    """Every occurrence of the prompt removed, then stripped."""
    return df.withColumn(out, strip_prompt_echo(full, prompt))
