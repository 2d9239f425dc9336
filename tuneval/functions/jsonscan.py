"""The first fault of a text that is no JSON value: its kind and its place.

A pushdown scanner over tokens, driven by one table: a state says which tokens
may come and, if another one comes, which fault that is. The stack holds the
open brackets, so depth costs no recursion. RFC 8259 decides what a token is
(``NaN`` and ``Infinity`` are none). Kinds and places are those of the parser
messages that the error classes are defined by, whatever the Python version.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# The kinds of faults.
VALUE, KEY, COLON, COMMA, EXTRA = "value", "key", "colon", "comma", "extra"
STRING, CONTROL, ESCAPE, MARK = "string", "control", "escape", "mark"

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_INNER = re.compile(r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*')

# state: (token: next state), what else comes is this fault. Other tokens than
# strings and scalars are the characters themselves, "" is the text's end. A
# state of None is the one that the enclosing bracket continues with.
_VALUE = {"scalar": None, "string": None, "{": "first key", "[": "first item"}
_TABLE = {
    "value": (_VALUE, VALUE),
    "first item": ({**_VALUE, "]": None}, VALUE),
    "first key": ({"string": "colon", "}": None}, KEY),
    "key": ({"string": "colon"}, KEY),
    "colon": ({":": "value"}, COLON),
    "in {": ({",": "key", "}": None}, COMMA),
    "in [": ({",": "value", "]": None}, COMMA),
    "end": ({"": "end"}, EXTRA),
}


def _token(text: str, at: int) -> tuple:
    """(token, place behind it, fault)."""
    c = text[at:at + 1]
    if c == '"':
        z = _INNER.match(text, at + 1).end()
        if text[z:z + 1] == '"':
            return "string", z + 1, None
        if z == len(text) or text[z:] == "\\":
            return "string", z, (STRING, at)
        return "string", z, (ESCAPE if text[z] == "\\" else CONTROL, z)
    m = _SCALAR.match(text, at)
    return ("scalar", m.end(), None) if m else (c, at + 1, None)


def first_fault(text: str) -> tuple | None:
    """(kind, place) of the first fault, or None for a JSON value."""
    if text.startswith("\ufeff"):
        return MARK, 0
    state, open_, at = "value", [], 0
    while True:
        at = _SPACE.match(text, at).end()
        token, behind, fault = _token(text, at)
        allowed, kind = _TABLE[state]
        if token not in allowed:
            return kind, at
        if fault:
            return fault
        if state == "end":
            return None
        if token in "{[":
            open_.append(token)
        elif token in "}]":
            open_.pop()
        state, at = allowed[token] or (f"in {open_[-1]}" if open_ else "end"), behind


def json_fault(c) -> Column:
    """Struct (kind, at) of the first fault; null for a JSON value or null text."""
    @F.pandas_udf("struct<kind:string,at:int>")
    def _msg(s: pd.Series) -> pd.DataFrame:
        found = [None if t is None else first_fault(t) for t in s]
        return pd.DataFrame({"kind": pd.Series([f and f[0] for f in found], dtype=object),
                             "at": pd.array([f and f[1] for f in found], dtype="Int32")})
    return _msg(c)
