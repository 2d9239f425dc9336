"""Cross-site boilerplate lines by distinct-site spread.

Lines are hashed; a HyperLogLog sketch of the sites that show a line is
merged by aggregation. Lines whose estimate is clearly at or above the
threshold are boilerplate, lines near it get an exact count of sites, and
boilerplate lines are cut from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

MIN_SITES = 10
LG_K = 12            # registers of a sketch: 2 ** LG_K, standard error 1.6 %
MARGIN = 0.1         # estimates within this share of the threshold are counted exactly
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text) -> Column:
    """Lines of a text (none for null)."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              site_col: str = "source") -> DataFrame:
    """(doc_id, h, site, n, line): a row per line that is not blank; ``h``
    hashes the document's text, ``line`` the trimmed line, ``n`` is its place."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
                    F.col(site_col).cast("string").alias("site"),
                    F.posexplode(_lines(F.col(text_col))).alias("n", "t"))
    t = F.btrim(F.col("t"), F.lit(BLANKS))
    return d.where(t != "").select("doc_id", "h", "site", "n", F.xxhash64(t).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line): hashes of lines that at least ``min_sites`` distinct sites show.

    Sketches merge per line, so a line that a third of all rows hold meets as
    one sketch per task. Only lines whose estimate lies within the margin of
    the threshold are gathered again, as distinct (line, site) pairs. A null
    site is no site.
    """
    est = (lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
                .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
                .where(F.col("sites") >= (1 - margin) * min_sites - 1))
    est = written(est, "line-sites")
    sure = est.where(F.col("sites") > (1 + margin) * min_sites + 1).select("line")
    near = est.where(F.col("sites") <= (1 + margin) * min_sites + 1).select("line")
    exact = (lines.join(near, "line", "left_semi").where("site is not null").select("line", "site").distinct()
                  .groupBy("line").count().where(F.col("count") >= min_sites).select("line"))
    return sure.unionByName(exact)


def _mask(places: str) -> Column:
    """Sorted places as bytes, "1" at each of them and "0" between: a byte is
    found by its place, so that many lines cost no more than each its own."""
    return F.array_join(F.transform(places, lambda n, i: F.concat(
        F.repeat(F.lit("0"), n - F.when(i > 0, F.get(places, i - 1)).otherwise(F.lit(-1)) - 1), F.lit("1"))),
        "").cast("binary")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", min_sites: int = MIN_SITES,
                       margin: float = MARGIN) -> DataFrame:
    """doc_id, text, n_lines, n_removed: every document without its boilerplate.

    ``text`` keeps the other lines as they are, in order; ``n_lines`` counts
    the lines that are not blank. A null text stays null with no lines, an
    empty one empty. Rows with equal id and text get equal results. Only
    line numbers of boilerplate are gathered per document, never lines; the work
    is linear in a document's lines.
    """
    lines = line_rows(docs, id_col, text_col, site_col)
    cut = written(boilerplate(lines, min_sites, margin), "boilerplate-lines")
    places = lines.join(cut, "line", "left_semi").groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set("n")).alias("n"))
    gone = written(places.select("doc_id", "h", _mask("n").alias("gone"), F.size("n").cast("long").alias("n_removed")),
                   "boilerplate-places")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                    F.xxhash64(F.col(text_col)).alias("h"))
    g = gone.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "gone", "n_removed")
    j = d.join(g, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left")
    rows = _lines(F.col("text"))
    kept = F.filter(rows, lambda t, n: F.substring(F.col("gone"), n + 1, F.lit(1)) != F.lit(b"1"))
    full = F.size(F.filter(rows, lambda t: F.btrim(t, F.lit(BLANKS)) != "")).cast("long")
    removed = F.coalesce("n_removed", F.lit(0).cast("long"))
    return j.select("doc_id",
                    F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                    full.alias("n_lines"), removed.alias("n_removed"))
