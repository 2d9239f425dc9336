"""JSON column expressions over Spark VARIANT.

A value is parsed once into a VARIANT column and every metric (validity,
canonical form, keys, types, equality) is derived from it (SURVEY §4.1).

Strictness (SURVEY T1): ``try_parse_json`` accepts trailing garbage, so the
text is wrapped as ``[<text>,<sentinel>]``; it is one JSON value exactly
when that array parses with two elements and the sentinel second.
RFC 8259 is the standard: ``NaN``/``Infinity`` are invalid (Python accepts
them). Duplicate keys keep the last value (session conf, T2).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The sentinel is a JSON string whose decoded value holds NUL
# characters, so no ordinary value can collide with it.
_SENTINEL_JSON = '"\\u0000tuneval-end-of-value\\u0000"'
_SENTINEL_VALUE = "\u0000tuneval-end-of-value\u0000"

# How a JSON value begins and ends. A text that does not is no
# value; it is told from here, since the parser throws an exception for each.
_OUTLINE = (r'(?s)^[ \t\n\r]*(?:\{[ \t\n\r]*(?:".*\}|\})|\[.*\]|".*"|-?[0-9].*|true|false|null)[ \t\n\r]*\z')

# The type names a response schema may use (metrics type check).
SCHEMA_TYPES = ("string", "number", "boolean", "array")
# First letters of the engine's type names that are no numbers.
TYPE_NAMES = (("OBJE", "object"), ("ARRA", "array"), ("STRI", "string"), ("BOOL", "boolean"), ("VOID", "null"))


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _wrapped(c) -> Column:
    """The items of the wrapped text, NULL where it does not parse."""
    w = F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit("," + _SENTINEL_JSON + "]")))
    return F.when(_col(c).rlike(_OUTLINE), F.try_variant_get(w, "$", "array<variant>"))


def _whole(items: Column) -> Column:
    return (F.size(items) == 2) & (F.try_variant_get(F.get(items, F.lit(1)), "$", "string") == F.lit(_SENTINEL_VALUE))


def strict_valid(c) -> Column:
    """``json.loads(x)`` succeeds (one value, nothing after it).

    The items are named once, so that a filter, too, parses a text once."""
    return F.coalesce(F.exists(F.array(_wrapped(c)), _whole), F.lit(False))


def parse_strict(c) -> Column:
    """VARIANT of a strictly valid text, else NULL (one parse)."""
    w = _wrapped(c)
    return F.when(_whole(w), F.get(w, F.lit(0)))


def with_parsed(df, text, ok_col: str, v_col: str):
    """Add ``ok_col`` (strictly valid) and ``v_col`` (VARIANT or NULL).

    The text is parsed once; later expressions refer to the two columns by
    name, so Catalyst keeps them as one projection instead of re-parsing in
    every branch that uses them.
    """
    w = "_w_" + v_col
    d = df.withColumn(w, _wrapped(text))
    ok = F.coalesce(_whole(F.col(w)), F.lit(False))
    return d.withColumns({ok_col: ok, v_col: F.when(ok, F.get(F.col(w), F.lit(0)))}).drop(w)


def canonical(v) -> Column:
    """key-sorted serialisation (``json.dumps(sort_keys=True)`` analogue)."""
    return F.to_json(_col(v))


def type_signature(v) -> Column:
    return F.schema_of_variant(_col(v))


def as_object(v) -> Column:
    """Top-level object as ``map<string,variant>``; NULL for non-objects."""
    return F.try_variant_get(_col(v), "$", "map<string,variant>")


def is_object(v) -> Column:
    """top-level value is an object."""
    return as_object(v).isNotNull()


def object_keys(v) -> Column:
    return F.map_keys(as_object(v))


def value_equal(v1, v2) -> Column:
    """parsed values equal (numbers compare by value: 1 == 1.0)."""
    return F.coalesce(canonical(v1) == canonical(v2), F.lit(False))


def canonical_equal(v1, v2) -> Column:
    """F6 on parsed values: same canonical text and same value types."""
    return F.coalesce((canonical(v1) == canonical(v2)) &
                      (type_signature(v1) == type_signature(v2)), F.lit(False))


def exact_match(pred, ref, v_pred, v_ref) -> Column:
    """canonical equality when both parse (``v_*`` are their parsed
    columns), else stripped-text equality."""
    from .text import utrim
    vp, vr = _col(v_pred), _col(v_ref)
    return F.when(vp.isNotNull() & vr.isNotNull(), canonical_equal(vp, vr)) \
            .otherwise(F.coalesce(utrim(pred) == utrim(ref), F.lit(False)))


def keys_subset(expected_v, response_v) -> Column:
    """F10 key test: both objects and expected keys ⊆ response keys."""
    ek, rk = object_keys(expected_v), object_keys(response_v)
    return F.coalesce(ek.isNotNull() & rk.isNotNull() & (F.size(F.array_except(ek, rk)) == 0),
                      F.lit(False))


def json_type_of(v) -> Column:
    """Coarse JSON type of a VARIANT value: object/array/string/number/boolean/null."""
    # the type is named once: a lambda evaluates each naming anew
    kind = F.substring(F.schema_of_variant(_col(v)), 1, 4)
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES for x in pair])
    return F.when(_col(v).isNotNull(), F.coalesce(F.element_at(names, kind), F.lit("number")))


def python_type_of(v) -> Column:
    """Name of the Python type that a JSON value is read as."""
    sv = F.schema_of_variant(_col(v))
    return (F.when(_col(v).isNull() | (sv == "VOID"), F.lit("NoneType"))
             .when(sv.startswith("OBJECT"), F.lit("dict"))
             .when(sv.startswith("ARRAY"), F.lit("list"))
             .when(sv == "STRING", F.lit("str"))
             .when(sv == "BOOLEAN", F.lit("bool"))
             .when(sv == "BIGINT", F.lit("int"))
             .otherwise(F.lit("float")))


def field_types(v) -> Column:
    """``map<field, coarse type>`` of a top-level object."""
    return F.transform_values(as_object(v), lambda k, x: json_type_of(x))


def type_ok(actual: Column, expected: Column) -> Column:
    """F9 single-field check. Booleans pass as numbers (Python bool is int);
    unknown type names are never checked."""
    return (F.when(expected == "string", actual == "string")
             .when(expected == "number", actual.isin("number", "boolean"))
             .when(expected == "boolean", actual == "boolean")
             .when(expected == "array", actual == "array")
             .otherwise(F.lit(True)))


def embedded_slice(c) -> Column:
    """Text from the first '{' to the last '}', NULL when absent."""
    x = _col(c)
    start = F.locate("{", x)
    last = F.length(x) - F.locate("}", F.reverse(x)) + 1
    ok = (start > 0) & (F.locate("}", F.reverse(x)) > 0) & (last > start)
    return F.when(ok, x.substr(start, (last - start + 1).cast("int")))


def embedded_regex(c) -> Column:
    """Greedy ``\\{.*\\}`` with DOTALL; '' (no match) becomes NULL."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))
