"""The scanner of the first fault against fixed cases and the json module."""

import json
import random

from tuneval.functions.jsonscan import first_fault, json_fault

# What a parser says -> kind of fault.
KINDS = (("Expecting value", "value"), ("Expecting property name", "key"), ("Expecting ':'", "colon"),
         ("Expecting ',' delimiter", "comma"), ("Extra data", "extra"), ("Unterminated string", "string"),
         ("Invalid control character", "control"), ("Invalid \\", "escape"), ("Unexpected UTF-8 BOM", "mark"),
         # newer parsers name the comma before a closing bracket and point at it
         ("Illegal trailing comma before end of object", "key"), ("Illegal trailing comma before end of array", "value"))


def parsed(text):
    """(kind, place) by the json module; NaN and the infinities are no JSON."""
    def constant(name):
        raise OverflowError
    try:
        json.loads(text, parse_constant=constant)
    except OverflowError:
        return "constant"
    except json.JSONDecodeError as e:
        kind = next(k for m, k in KINDS if e.msg.startswith(m))
        return kind, None if e.msg.startswith("Illegal trailing comma") or kind == "escape" else e.pos
    return None


def test_goldens():
    for text, want in {
            "": ("value", 0), "  ": ("value", 2), "{": ("key", 1), "[": ("value", 1), "{'a': 1}": ("key", 1),
            '{"a" 1}': ("colon", 5), '{"a": }': ("value", 6), '{"a": 1 "b": 2}': ("comma", 8), '{"a": 1,}': ("key", 8),
            "[1,]": ("value", 3), "[1 2]": ("comma", 3), '{"a": 1} x': ("extra", 9), '"abc': ("string", 0),
            '{"a": "x': ("string", 6), '"a\nb"': ("control", 2), '"a\\qb"': ("escape", 2), '"a\\': ("string", 0),
            "01": ("extra", 1), "-": ("value", 0), "1.": ("extra", 1), "nul": ("value", 0), "NaN": ("value", 0),
            "[-Infinity]": ("value", 1), "\ufeff{}": ("mark", 0), "]": ("value", 0), "[1}": ("comma", 2),
            '{"a": 1]': ("comma", 7), "{}{}": ("extra", 2), "Sure: {}": ("value", 0)}.items():
        assert first_fault(text) == want, text
    for text in ("{}", "[]", " [1, -0.5e+3, true, false, null] ", '{"a": {"b": [{}]}}', '"\\u00e9\\n"', "0",
                 "[" * 50_000 + "]" * 50_000):
        assert first_fault(text) is None


def test_random_mutations():
    rng = random.Random(5)
    seeds = ['{"a": [1, 2.5, {"b": "x\\n\\u0041"}], "c": null, "d": true}', '[{"k": "v"}, "s", -1e5, []]', "{}", '"t"']
    for _ in range(20_000):
        t = list(rng.choice(seeds))
        for _ in range(rng.randrange(1, 4)):
            k, c = rng.randrange(len(t) + 1), rng.choice('{}[]:,"\\ 01-.eE\n\tabtrufalsn')
            t[k:k + rng.randrange(2)] = c if rng.random() < 0.7 else ""
        t = "".join(t)
        want, got = parsed(t), first_fault(t)
        if want == "constant":
            continue
        if want and want[1] is None:
            assert got and got[0] == want[0], t
        else:
            assert got == want, t


def test_column(spark):
    d = spark.createDataFrame([(1, "[1,"), (2, "{}"), (3, None)], "id int, t string")
    got = {r.id: r.f and tuple(r.f) for r in d.select("id", json_fault("t").alias("f")).collect()}
    assert got[1] == ("value", 3) and got[2] in (None, (None, None)) and got[3] in (None, (None, None))
