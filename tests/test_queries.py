"""Every registered query against its DuckDB oracle (sf0.001) and plan checks."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from plan_log import faults  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = list(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"checkpoint", "n", "valid_pct", "schema_pct", "exact_pct"}


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


# beyond SQL: checked by rows here and by value in their own tests
NO_ORACLE = {n for n in NAMES if re.match(r"op([1-79]|12)_", n)} | {"pipeline", "open_suite_rouge_l"}


# a window over one row per training run
ONE_TASK = {"loss_curve"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, plan_log, name):
    plan_log.new()
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert r["ok"] is (None if name in NO_ORACLE else True) and r["rows"] >= 0, r
    plans = plan_log.new()
    assert plans
    assert name in ONE_TASK or [f for p in plans for f in faults(p)] == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the only scalar Python outside llm/: the scanner of faults (F2a), LCS (G3), stemmer (G4), BERTScore
ALLOWED_UDFS = {"_msg", "_rouge_l_udf", "stem_tokens", "_bert_udf"}


@pytest.mark.parametrize("name", [n for n in NAMES if n not in E.LLM_QUERIES])
def test_only_known_udfs(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDFs
    for line in plan.splitlines():
        if "ArrowEvalPython" in line:
            names = set(re.findall(r"(\w+)\(", line.split("ArrowEvalPython", 1)[1]))
            assert names & ALLOWED_UDFS, line
