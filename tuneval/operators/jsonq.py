"""Structured-output quality: validity, compliance, exact match, taxonomies.

The response text is parsed once into VARIANT; every flag derives from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonfn as J
from ..functions.jsonscan import COLON, COMMA, EXTRA, KEY, STRING, VALUE, json_fault
from ..functions.text import fence_strip_regex, utrim


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def judge_json_flags(df: DataFrame, response: str = "response", expected: str = "expected",
                     prefix: str = "") -> DataFrame:
    """F10 (+F3b, F1, F7): ``valid``, ``schema``, ``exact`` as 0/1 ints.

    Response is fence-stripped (regex form) then parsed strictly. An
    unparsable *expected* keeps valid=1 and gives schema=exact=0. Exact
    implies schema; otherwise schema = both objects and expected keys ⊆
    response keys. Each text is parsed once, the expected one only if the
    response is valid and another text.
    """
    d = df.withColumn("_clean", fence_strip_regex(response))
    d = J.with_parsed(d, "_clean", "_ok", "_vr")
    # equal texts have equal values: the expected one is parsed where it differs
    d = d.withColumn("_same", F.col("_ok") & F.col("_clean").eqNullSafe(_col(expected)))
    d = J.with_parsed(d, F.when(F.col("_ok") & ~F.col("_same"), _col(expected)), "_oke", "_ve")
    d = d.withColumn("_exact", F.col("_same") | (F.col("_oke") & J.value_equal("_vr", "_ve")))
    schema = F.col("_exact") | (F.col("_ok") & J.keys_subset("_ve", "_vr"))
    return (d.withColumn(prefix + "valid", F.col("_ok").cast("int"))
             .withColumn(prefix + "schema", schema.cast("int"))
             .withColumn(prefix + "exact", F.col("_exact").cast("int"))
             .drop("_clean", "_vr", "_ok", "_ve", "_oke", "_same", "_exact"))


def pct(flag: str) -> Column:
    """``100 * mean(flag)`` as double, rounded to 6 places (0 when empty)."""
    return F.round(F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)) * 100.0, 6)


def judge_json_rates(flags: DataFrame, by=("checkpoint",)) -> DataFrame:
    """valid/schema/exact percentages per group (map-side partial agg)."""
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                  pct("valid").alias("valid_pct"),
                                  pct("schema").alias("schema_pct"),
                                  pct("exact").alias("exact_pct"))


# ------------------------------------------------------------------ F2a/F2b
def error_taxonomy(df: DataFrame, response: str = "response", by=("checkpoint",),
                   form: str = "detailed") -> DataFrame:
    """F2a (``detailed``: stripped text, 9 classes) or F2b (``inline``: raw
    text, 5 classes): counts of invalid outputs per class.

    Only strictly invalid texts reach the scanner of the first fault, as the
    others are NULL to it. No filter does this: it would be pushed below the
    projections and evaluate the parse and all that made the text several times
    a row. Counting is a native partial aggregate. A text that is a JSON value
    but not one the engine's VARIANT takes (nested beyond 1,000 levels, numbers
    of more than 1,000 digits, beyond its size limit) is ``engine_limit``: no
    fault of the model. The class names below are fixed values.
    """
    text = utrim(response) if form == "detailed" else F.coalesce(_col(response), F.lit(""))
    m = J.with_parsed(df.select(*by, text.alias("_all")), "_all", "_ok", "_v")
    m = m.select(*by, F.when(~F.col("_ok"), F.col("_all")).alias("_t")).withColumn("_k", json_fault("_t")["kind"])
    t, kind = F.col("_t"), F.col("_k")
    cls = F.when(t.isNull(), F.lit(None)).when(kind.isNull(), "engine_limit").when(kind == VALUE, "invalid_value")
    if form == "detailed":
        cls = (cls.when(kind.isin(KEY, COLON), "missing_colon_or_key")
                .when(kind == COMMA, "missing_comma")
                .when(kind == EXTRA, "extra_data")
                .when(kind == STRING, "unterminated_string")
                .when(~(t.startswith("{") | t.startswith("[")), "not_json_format")
                .when(_count(t, "{") != _count(t, "}"), "unmatched_braces")
                .when(_count(t, "[") != _count(t, "]"), "unmatched_brackets")
                .otherwise("other_error"))
    else:
        cls = (cls.when(kind == KEY, "missing_key")
                .when(kind == COLON, "missing_colon")
                .when(kind == COMMA, "missing_comma")
                .otherwise("other_error"))
    return m.groupBy(*by, cls.alias("error_class")).agg(F.count("_t").alias("n")).where(F.col("n") > 0)


def _count(x: Column, ch: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))


# ------------------------------------------------------------------ F8, F9, F11
# The message for a response that is no object.
NOT_AN_OBJECT = "Output is not a JSON object"


def schema_check(df: DataFrame, response: str = "response", schema: str = "schema",
                 prefix: str = "", keep_parsed: bool = False) -> DataFrame:
    """F8 + F9 + F11 on a strictly parsed response.

    Adds ``valid``, ``is_object``, ``missing_fields`` (array), ``type_errors``
    (array of field names) and ``compliant`` (object, nothing missing, no
    type error). A NULL schema means ``{}``: any object passes. With
    ``keep_parsed`` the VARIANT stays as ``<prefix>v``. ``errors`` tells every
    violation in words, with the expected and the actual type.
    """
    empty = F.array().cast("array<string>")
    d = J.with_parsed(df, response, prefix + "ok", prefix + "v")
    d = d.withColumn("_obj", J.as_object(prefix + "v"))
    d = d.withColumn("_keys", F.coalesce(F.map_keys("_obj"), empty)) \
         .withColumn("_ft", F.transform_values("_obj", lambda k, x: J.json_type_of(x)))
    req = F.coalesce(F.col(schema + ".required_fields"), empty)
    types = F.coalesce(F.col(schema + ".types"), F.create_map().cast("map<string,string>"))
    missing = F.array_except(req, F.col("_keys"))
    bad = F.filter(F.map_keys(types), lambda f: F.array_contains(F.col("_keys"), f) &
                   ~J.type_ok(F.element_at(F.col("_ft"), f), F.element_at(types, f)))
    obj = F.col("_obj").isNotNull()
    d = (d.withColumn(prefix + "valid", F.col(prefix + "ok").cast("int"))
          .withColumn(prefix + "is_object", obj.cast("int"))
          .withColumn(prefix + "missing_fields", F.when(obj, missing))
          .withColumn(prefix + "type_errors", F.when(obj, bad)))
    # the actual types of the few offending fields only
    wrong = F.transform(prefix + "type_errors", lambda f: F.concat(
        F.lit("Field '"), f, F.lit("' should be "), F.element_at(types, f), F.lit(", got "),
        J.python_type_of(F.element_at(F.col("_obj"), f))))
    gone = F.transform(prefix + "missing_fields", lambda f: F.concat(F.lit("Missing required field: "), f))
    d = d.withColumn(prefix + "errors", F.when(obj, F.concat(gone, wrong)).otherwise(F.array(F.lit(NOT_AN_OBJECT))))
    d = d.withColumn(prefix + "compliant",
                     F.coalesce(obj & (F.size(prefix + "missing_fields") == 0) &
                                (F.size(prefix + "type_errors") == 0), F.lit(False)).cast("int"))
    drop = ["_obj", "_ft", prefix + "ok"] + ([] if keep_parsed else [prefix + "v"])
    if not keep_parsed:
        drop.append("_keys")
    return d.drop(*drop)


def suite_metrics(df: DataFrame, response="response", expected="expected", schema="schema",
                  by=("checkpoint",)) -> DataFrame:
    """Validity, compliance and exact-match rates over all rows.

    Compliance and exact match only count valid rows (no fence strip, as in
    the metrics module). Also ``compliance_of_valid`` (the report's
    denominator). Rates are 0 for an empty group.
    """
    s = schema_check(df, response, schema, keep_parsed=True)
    # equal texts match exactly: the expected one is parsed where it differs
    s = s.withColumn("_same", (F.col("valid") == 1) & _col(response).eqNullSafe(_col(expected)))
    s = J.with_parsed(s, F.when((F.col("valid") == 1) & ~F.col("_same"), _col(expected)), "_oke", "_ve")
    s = s.withColumn("exact", F.col("_same") | ((F.col("valid") == 1) & J.exact_match(response, expected, "v", "_ve"))) \
         .drop("v", "_keys", "_oke", "_ve", "_same")
    n = F.count(F.lit(1))
    nv = F.sum("valid")
    return s.groupBy(*by).agg(
        n.alias("count"),
        F.round(nv / n, 6).alias("validity_rate"),
        F.round(F.sum(F.col("compliant") * F.col("valid")) / n, 6).alias("compliance_rate"),
        F.round(F.sum(F.col("exact").cast("int")) / n, 6).alias("exact_match_rate"),
        F.round(F.coalesce(F.sum(F.col("compliant") * F.col("valid")) / F.nullif(nv, F.lit(0)),
                           F.lit(0.0)), 6).alias("compliance_of_valid"))


# ------------------------------------------------------------------ F12, F13
def brace_balance(df: DataFrame, col: str = "response") -> DataFrame:
    """open/close brace and bracket counts."""
    x = F.coalesce(_col(col), F.lit(""))
    return df.withColumn("open_braces", _count(x, "{").cast("int")) \
             .withColumn("close_braces", _count(x, "}").cast("int")) \
             .withColumn("open_brackets", _count(x, "[").cast("int")) \
             .withColumn("close_brackets", _count(x, "]").cast("int"))


def field_f1(df: DataFrame, response="response", expected="expected") -> DataFrame:
    """per-row field precision/recall/F1 over (key, canonical value) pairs.

    Computed in-row on the parsed objects (no explode, no shuffle). Values
    compare canonically; a non-object side has no fields.
    """
    def pairs(v):
        return F.transform(F.map_entries(J.as_object(v)),
                           lambda e: F.concat(e["key"], F.lit("\u0001"), F.to_json(e["value"])))
    d = J.with_parsed(df.withColumn("_t", fence_strip_regex(response)), "_t", "_okp", "_vp")
    d = J.with_parsed(d, expected, "_oke", "_ve")
    d = d.withColumn("_p", F.coalesce(pairs("_vp"), F.array().cast("array<string>"))) \
         .withColumn("_e", F.coalesce(pairs("_ve"), F.array().cast("array<string>"))) \
         .drop("_t", "_okp", "_vp", "_oke", "_ve")
    tp = F.size(F.array_intersect("_p", "_e"))
    np_, ne = F.size("_p"), F.size("_e")
    prec = F.when(np_ > 0, tp / np_).otherwise(F.lit(0.0))
    rec = F.when(ne > 0, tp / ne).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return d.withColumn("field_precision", prec).withColumn("field_recall", rec) \
            .withColumn("field_f1", f1).drop("_p", "_e")


# ------------------------------------------------------------------ F2c, J16
def report_taxonomy(df: DataFrame, response="response", schema="schema") -> DataFrame:
    """Report-style error class per row (NULL when the row is clean).

    Our rules, first match wins, on the fence-stripped text:
    empty; trailing_comma (``,`` before a closing brace/bracket);
    quote_mismatch (single-quoted keys or strings); truncated (starts with an
    opener, more openers than closers); wrapped_text (JSON inside prose);
    missing_brackets (any other imbalance, or no opener); other_invalid; then for valid
    text: type_error, missing_fields, extra_fields (keys outside the schema).
    """
    d = schema_check(df.withColumn("_t", fence_strip_regex(response)), "_t", schema,
                     prefix="_s_", keep_parsed=True)
    t = F.col("_t")
    d = (d.withColumn("_ob", _count(t, "{")).withColumn("_cb", _count(t, "}"))
          .withColumn("_oa", _count(t, "[")).withColumn("_ca", _count(t, "]")))
    ob, cb, oa, ca = F.col("_ob"), F.col("_cb"), F.col("_oa"), F.col("_ca")
    starts = t.startswith("{") | t.startswith("[")
    req = F.coalesce(F.col(schema + ".required_fields"), F.array().cast("array<string>"))
    allowed = F.array_union(req, F.map_keys(F.coalesce(F.col(schema + ".types"),
                                                       F.create_map().cast("map<string,string>"))))
    extra = F.size(F.array_except(F.col("_keys"), allowed)) > 0
    cls = (F.when(t == "", "empty")
            .when(F.col("_s_valid") == 0,
                  F.when(t.rlike(r",\s*[}\]]"), "trailing_comma")
                   .when(t.rlike(r"'[^']*'\s*:|:\s*'"), "quote_mismatch")
                   .when(starts & ((ob > cb) | (oa > ca)), "truncated")
                   .when(~starts & ((ob > 0) | (oa > 0)), "wrapped_text")
                   .when(~starts | (ob != cb) | (oa != ca), "missing_brackets")
                   .otherwise("other_invalid"))
            .when(F.size(F.col("_s_type_errors")) > 0, "type_error")
            .when(F.size(F.col("_s_missing_fields")) > 0, "missing_fields")
            .when((F.col("_s_is_object") == 1) & extra, "extra_fields"))
    out = d.withColumn("report_class", cls)
    return out.drop("_t", "_keys", "_ob", "_cb", "_oa", "_ca",
                    *[c for c in out.columns if c.startswith("_s_")])


def error_resolution(classes: DataFrame, before="cp0", after="cp2", cls="report_class",
                     by="checkpoint") -> DataFrame:
    """Per error class, counts before/after and (n1-n2)/n1."""
    # grouped over all rows (NULL = clean): a filter on the derived class
    # would be pushed below the projections and re-evaluate the parse
    c = classes.groupBy(cls).agg(
        F.count(F.when(F.col(by) == before, 1)).alias("n_before"),
        F.count(F.when(F.col(by) == after, 1)).alias("n_after"))
    return c.withColumn("resolution", F.round(F.when(F.col("n_before") > 0,
                        (F.col("n_before") - F.col("n_after")) / F.col("n_before")), 6))


def rates_by_task(flags: DataFrame, task="task_type", by="checkpoint") -> DataFrame:
    """validity/compliance/exact % per (checkpoint, task), per checkpoint
    and overall, via ROLLUP (grouping sets) with its grouping id."""
    return flags.rollup(by, task).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        pct("valid").alias("valid_pct"), pct("schema").alias("schema_pct"),
        pct("exact").alias("exact_pct"))
