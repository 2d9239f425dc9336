"""Golden tests for JSON semantics (F1-F13, SURVEY T1-T5)."""

import json

import pytest
from pyspark.sql import functions as F

from tuneval.functions import jsonfn as J
from tuneval.functions.text import fence_strip_prefix, fence_strip_regex
from tuneval.operators import jsonq

STRICT_CASES = [
    '{"a": 1}', '  [1, 2]  ', '"s"', "1", "null", "true", '{"a":1} x', "{'a':1}", "",
    '{"a":1,}', '[1,]', '{"a": [1, {"b": null}]}', '{"a":1}{"b":2}', '1 2', '{"a":1,"a":2}',
    '"unterminated', '{"a" 1}', '\n{"a":\n1}\n',
]


def test_strict_validity_matches_python(spark):
    df = spark.createDataFrame([(x,) for x in STRICT_CASES], "x string")
    got = {r.x: r.ok for r in df.select("x", J.strict_valid("x").alias("ok")).collect()}

    def py(x):
        try:
            json.loads(x)
            return True
        except ValueError:
            return False
    assert got == {x: py(x) for x in STRICT_CASES}


def test_nan_is_invalid_by_rfc(spark):
    df = spark.createDataFrame([("NaN",), ('{"a": Infinity}',)], "x string")
    assert [r.ok for r in df.select(J.strict_valid("x").alias("ok")).collect()] == [False, False]


def test_fence_strips(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("```\n[1]\n```",), ("plain",), ("```json",)]
    df = spark.createDataFrame(rows, "x string")
    out = df.select(fence_strip_prefix("x").alias("p"), fence_strip_regex("x").alias("r")).collect()
    assert out[0].p == '\n{"a": 1}\n' and out[0].r == '{"a": 1}'
    assert out[1].p == "\n[1]\n"
    assert out[2].p == "plain" and out[2].r == "plain"
    assert out[3].p == ""


def test_embedded_slice(spark):
    rows = [("Verdict: {\"w\": 1} End.",), ("no braces",), ("} then {",), ("{a}{b}",)]
    df = spark.createDataFrame(rows, "x string")
    out = [r[0] for r in df.select(J.embedded_slice("x")).collect()]
    assert out == ['{"w": 1}', None, None, "{a}{b}"]
    out2 = [r[0] for r in df.select(J.embedded_regex("x")).collect()]
    assert out2 == ['{"w": 1}', None, None, "{a}{b}"]


def test_exact_match_canonical_vs_value(spark):
    rows = [('{"b":1,"a":2}', '{"a":2,"b":1}'), ('{"a":1.0}', '{"a":1}'), ('x ', 'x')]
    df = spark.createDataFrame(rows, "p string, r string")
    df = J.with_parsed(J.with_parsed(df, "p", "okp", "vp"), "r", "okr", "vr")
    out = df.select(J.exact_match("p", "r", "vp", "vr").alias("f6"),
                    J.value_equal("vp", "vr").alias("f7")).collect()
    assert (out[0].f6, out[0].f7) == (True, True)
    assert (out[1].f6, out[1].f7) == (False, True)     # 1.0 vs 1: F6 differs, F7 equal
    assert out[2].f6 is True                           # both unparsable: stripped text


def test_schema_check_bool_passes_as_number(spark):
    spec = "struct<required_fields:array<string>,types:map<string,string>>"
    rows = [('{"n": true, "s": "x"}',), ('{"s": 1}',), ('[1]',), ('{"n": 1, "s": "x", "z": 1}',)]
    df = spark.createDataFrame(rows, "response string").withColumn(
        "schema", F.expr(f"cast(named_struct('required_fields', array('n','s'), 'types', "
                         f"map('n','number','s','string','z','integer')) as {spec})"))
    out = jsonq.schema_check(df).collect()
    assert out[0].compliant == 1                       # bool counts as number
    assert out[1].compliant == 0 and out[1].missing_fields == ["n"] and out[1].type_errors == ["s"]
    assert out[2].is_object == 0 and out[2].compliant == 0
    assert out[3].compliant == 1                       # unknown type name never checked


def test_error_taxonomy_classes(spark):
    rows = [("", "cp"), ('{"a" 1}', "cp"), ('{"a": 1 "b": 2}', "cp"), ('{"a": 1} x', "cp"),
            ('{"a": "x', "cp"), ('{"a": 1,}', "cp"), ("[1,]", "cp"), ("{'a': 1}", "cp")]
    df = spark.createDataFrame(rows, "response string, checkpoint string")
    got = {r.error_class: r.n for r in jsonq.error_taxonomy(df).collect()}
    assert got == {"invalid_value": 2, "missing_colon_or_key": 3, "missing_comma": 1,
                   "extra_data": 1, "unterminated_string": 1}
    inline = {r.error_class: r.n for r in jsonq.error_taxonomy(df, form="inline").collect()}
    assert inline == {"invalid_value": 2, "missing_key": 2, "missing_colon": 1,
                      "missing_comma": 1, "other_error": 2}


def test_judge_flags_order(spark):
    rows = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": 1, "b": 2}', '{"a": 1}'),
            ('{"a": 1}', 'not json'), ('{"b": 1}', '{"a": 1}')]
    df = spark.createDataFrame(rows, "response string, expected string")
    out = [(r.valid, r.schema, r.exact) for r in jsonq.judge_json_flags(df).collect()]
    assert out == [(1, 1, 1), (1, 1, 0), (1, 0, 0), (1, 0, 0)]


def test_field_f1(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}', '{"a": 1, "b": 3, "c": 4}')],
                               "response string, expected string")
    r = jsonq.field_f1(df).collect()[0]
    assert r.field_precision == pytest.approx(0.5) and r.field_recall == pytest.approx(1 / 3)
    assert r.field_f1 == pytest.approx(0.4)


def test_unicode_strip_like_python(spark):
    from tuneval.functions.text import rtrim_ws, utrim, word_count
    rows = ["  x y ", "\x1c\tz\x85", "", "  　 ", "a b"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    out = df.select(utrim("x").alias("s"), rtrim_ws("x").alias("r"), word_count("x").alias("w")).collect()
    assert [r.s for r in out] == [x.strip() for x in rows]
    assert [r.r for r in out] == [x.rstrip() for x in rows]
    assert [r.w for r in out][:2] == [len(rows[0].split()), 1] and out[4].w == 2
