"""Property tests: validity agrees with the Python parser on
random JSON-like text; results do not depend on the partition count."""

import json

from hypothesis import given, settings, strategies as st

import __spark_entry__ as E
from tuneval.functions import jsonfn as J

# JSON-ish alphabet without the letters of NaN/Infinity (RFC-invalid, Python-valid)
ALPHABET = st.sampled_from(list('{}[]:,"0123456789.-+eE truefalsn\\') + ["\n", "\t", "x"])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=200, max_size=200)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=5),
                      lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c,
                                                                          max_size=3),
                      max_leaves=8)


def _py_valid(x):
    try:
        json.loads(x)
        return True
    except ValueError:
        return False


@settings(max_examples=3, deadline=None)
@given(TEXTS, st.lists(VALUES, min_size=50, max_size=50))
def test_strict_valid_agrees_with_python(spark, texts, values):
    # random fragments (mostly invalid) plus serialised values (valid, and
    # with a trailing fragment mostly invalid)
    rows = texts + [json.dumps(v) for v in values] + [json.dumps(v) + " ]" for v in values]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = {r.i: r.ok for r in df.select("i", J.strict_valid("x").alias("ok")).collect()}
    bad = [(rows[i], got[i]) for i in range(len(rows)) if got[i] != _py_valid(rows[i])]
    assert not bad, bad[:5]


def test_results_independent_of_partition_count(spark):
    q = E.queries()
    out = {}
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out[n] = {name: sorted(map(tuple, q[name](spark, "/root/testdata/sf0.001").collect()))
                  for name in ("json_judge_rates", "responses_fraction_prefix", "open_suite_metrics",
                               "judge_win_rates")}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out["1"] == out["8"]
