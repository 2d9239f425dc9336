"""Judge-verdict operators.

Raw judge replies are an input table keyed by (comparison, prompt_id) with
the display-order ``swap`` flag; they are parsed once into VARIANT and
normalised with column expressions. Convention: response A is the
comparison's challenger, B its opponent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonfn as J
from ..schemas import DIMENSIONS

# Winner labels a verdict may carry.
WINNERS = ("A", "B", "TIE")
DEFAULT_SCORE = 3
INT_TEXT = "^ *([+-]?[0-9]+) *$"


def parse_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """H1: whole reply as JSON, else the first-'{'-to-last-'}' slice, else an
    error row. A slice that does not parse, or a value that is not an
    object, is an error too. Adds ``verdict`` (VARIANT) and ``error``."""
    d = J.with_parsed(df, raw, "_ok1", "_v1")
    d = d.withColumn("_slice", J.embedded_slice(raw))
    d = J.with_parsed(d, "_slice", "_ok2", "_v2")
    v = F.when(F.col("_ok1"), F.col("_v1")).otherwise(F.col("_v2"))
    d = d.withColumn("verdict", F.when(J.is_object(v), v))
    err = (F.when(F.col("verdict").isNotNull(), F.lit(None).cast("string"))
            .when(F.col("_ok1") | F.col("_ok2"), F.lit("verdict is not an object"))
            .when(F.col("_slice").isNotNull(), F.lit("embedded JSON does not parse"))
            .otherwise(F.lit("Could not parse judge response")))
    return d.withColumn("error", err).drop("_ok1", "_v1", "_slice", "_ok2", "_v2")


def _type_sql(x: str) -> str:
    """Coarse JSON type of a VARIANT SQL expression (as ``jsonfn.json_type_of``)."""
    names = ", ".join(f"'{k}', '{name}'" for k, name in J.TYPE_NAMES)
    return (f"case when {x} is not null then coalesce(element_at(map({names}), "
            f"substring(schema_of_variant({x}), 1, 4)), 'number') end")


def _dims_sql() -> str:
    return "array(" + ", ".join(f"'{d}'" for d in DIMENSIONS) + ")"


def _values_sql(v: str, side: str) -> str:
    """Array of the side's score values (VARIANT), NULL where absent."""
    return "array(" + ", ".join(f"try_variant_get({v}, '$.response_{side}_scores.{d}', 'variant')"
                                for d in DIMENSIONS) + ")"


def raw_scores(v: str, side: str) -> Column:
    """``map<dim, double>`` of numeric (or boolean) scores present (judge form).

    ``v`` is the name of the VARIANT column."""
    vals = (f"transform({_values_sql(v, side)}, s -> case when ({_type_sql('s')}) in ('number', 'boolean') "
            "then try_variant_get(s, '$', 'double') end)")
    return F.expr(f"map_filter(map_from_arrays({_dims_sql()}, {vals}), (k, x) -> x is not null)")


def normalized_scores(v: str, side: str) -> Column:
    """H2: missing dimension -> 3, else ``int()`` clamped to 1..5; NULL when
    the side's score object is absent.

    What ``int()`` takes counts as a score: numbers (cut towards zero),
    booleans and strings of digits. Any other value that is present (null,
    text, list, object) is NULL here, which ``normalize_verdicts`` turns into
    an error."""
    number = (f"transform({_values_sql(v, side)}, s -> struct(s is null as absent, "
              f"case ({_type_sql('s')}) when 'number' then try_variant_get(s, '$', 'double') "
              "when 'boolean' then try_variant_get(s, '$', 'double') "
              f"when 'string' then try_cast(regexp_extract(try_variant_get(s, '$', 'string'), '{INT_TEXT}', 1) "
              "as double) end as n))")
    vals = (f"transform({number}, x -> case when x.absent then {DEFAULT_SCORE} when x.n is not null "
            "then cast(least(5, greatest(1, floor(abs(x.n)) * signum(x.n))) as int) end)")
    obj = f"try_variant_get({v}, '$.response_{side}_scores', 'map<string,variant>')"
    return F.expr(f"case when {obj} is not null then map_from_arrays({_dims_sql()}, {vals}) end")


def normalize_verdicts(parsed: DataFrame, swap: str = "swap") -> DataFrame:
    """H2-H4: scores normalised, winner normalised (unknown -> TIE), then
    unswapped back to (challenger=A, opponent=B). A verdict with a score that
    is no number is an error: it has no winner and no scores."""
    v = F.col("verdict")
    w = F.try_variant_get(v, "$.winner", "string")
    d = parsed.withColumns({
        "_wn": F.when(w.isin(*WINNERS), w).otherwise(F.lit("TIE")),
        "_a": normalized_scores("verdict", "a"), "_b": normalized_scores("verdict", "b"),
        "_ra": raw_scores("verdict", "a"), "_rb": raw_scores("verdict", "b")})
    empty = F.create_map().cast("map<string,int>")
    bad = F.exists(F.map_values(F.coalesce(F.col("_a"), empty)), lambda x: x.isNull()) | \
        F.exists(F.map_values(F.coalesce(F.col("_b"), empty)), lambda x: x.isNull())
    sw = F.col(swap) == 1
    d = d.withColumn("error", F.when(F.col("error").isNull() & bad, F.lit("invalid score"))
                     .otherwise(F.col("error")))
    ok = F.col("error").isNull()
    out = d.withColumns({
        "winner": F.when(F.col("error").isNotNull(), F.lit(None))
                   .when(sw & (F.col("_wn") == "A"), "B")
                   .when(sw & (F.col("_wn") == "B"), "A").otherwise(F.col("_wn")),
        "scores_a": F.when(ok, F.when(sw, F.col("_b")).otherwise(F.col("_a"))),
        "scores_b": F.when(ok, F.when(sw, F.col("_a")).otherwise(F.col("_b"))),
        "raw_scores_a": F.when(sw, F.col("_rb")).otherwise(F.col("_ra")),
        "raw_scores_b": F.when(sw, F.col("_ra")).otherwise(F.col("_rb"))})
    return out.drop("_wn", "_a", "_b", "_ra", "_rb")


def row_mean(scores: Column) -> Column:
    """Mean of a side's scores (NULL when there are none)."""
    vals = F.map_values(scores)
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) /
                  F.size(vals))


def win_counts(v: DataFrame, by=("comparison",)) -> DataFrame:
    """Per comparison total_pairs (valid verdicts), error_count and how many
    say A, B and TIE; counts of parts of the verdicts may be added."""
    ok = F.col("error").isNull()

    def won(w):
        return F.count(F.when(ok & (F.col("winner") == w), 1))
    return v.groupBy(*by).agg(F.count(F.when(ok, 1)).alias("total_pairs"), F.count(F.when(~ok, 1)).alias("error_count"),
                              won("A").alias("wins_a"), won("B").alias("wins_b"), won("TIE").alias("ties"))


def rates_of(counts: DataFrame, by=("comparison",), keep=()) -> DataFrame:
    """H5, H6, H8, H9, H10 of ``win_counts``: rates among the valid (0 when none);
    ``challenger_wins`` counts A; ``pct_*`` are floor(100*x/total)."""
    total = F.col("total_pairs")

    def rate(x):
        return F.round(F.when(total > 0, x / total).otherwise(F.lit(0.0)), 6)

    def pct(x):
        return F.when(total > 0, F.floor(100 * x / total)).otherwise(F.lit(0)).cast("bigint")
    wa, wb, wt = F.col("wins_a"), F.col("wins_b"), F.col("ties")
    return counts.select(
        *by, "total_pairs", "error_count", wa.alias("challenger_wins"), rate(wa).alias("win_rate_a"),
        rate(wb).alias("win_rate_b"), rate(wt).alias("tie_rate"), pct(wa).alias("pct_a"), pct(wb).alias("pct_b"),
        pct(wt).alias("pct_tie"), *keep)


def win_rates(v: DataFrame, by=("comparison",)) -> DataFrame:
    """H5, H6, H8, H9, H10 per comparison; see ``rates_of``."""
    return rates_of(win_counts(v, by), by)


def dimension_averages(v: DataFrame, by=("comparison",)) -> DataFrame:
    """H7: mean raw score per dimension and side over valid rows (0 if none).

    Each side's map is exploded into (dim, score) rows and averaged with a
    partial aggregate; a dimension seen on neither side still gets a row.
    """
    # error rows contribute NULL maps (explode emits nothing) instead of a
    # filter: a filter on ``error`` would be pushed below the projections and
    # inline the whole parse into its condition
    ok = F.col("error").isNull()
    ex = v.select(*by, F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.when(ok, F.col("raw_scores_a")).alias("m")),
        F.struct(F.lit("b").alias("side"), F.when(ok, F.col("raw_scores_b")).alias("m"))))
        .alias("s")) \
        .select(*by, "s.side", F.explode("s.m").alias("dimension", "score"))
    agg = ex.groupBy(*by, "dimension").agg(
        F.avg(F.when(F.col("side") == "a", F.col("score"))).alias("a"),
        F.avg(F.when(F.col("side") == "b", F.col("score"))).alias("b"))
    dims = v.select(*by).distinct().select(*by, F.explode(F.array(
        *[F.lit(d) for d in DIMENSIONS])).alias("dimension"))
    return (dims.join(agg, [*by, "dimension"], "left")
                .select(*by, "dimension",
                        F.round(F.coalesce(F.col("a"), F.lit(0.0)), 6).alias("response_a_mean"),
                        F.round(F.coalesce(F.col("b"), F.lit(0.0)), 6).alias("response_b_mean")))
