"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)``, reads the driver's tables, builds the
stand-in input through ``sources.fixtures`` and runs library operators on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources import fixtures as fx
from ..operators import jsonq
from .oracle_fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Reusable DuckDB expressions (the oracle only; Spark uses the operators).
D_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def d_trim(x: str) -> str:
    return D_TRIM.format(x=x)


def d_fence(x: str) -> str:
    return d_trim(f"regexp_replace({d_trim(x)}, '(?m)^```json\\s*|```$', '', 'g')")


def sq(s: str) -> str:
    """DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


# ---------------------------------------------------------------- JSON suite
D_JSON_FLAGS = """json_flags as (
  select *, cast(ok as int) as valid,
         cast(exact_b or (obj_r and obj_e and list_has_all(json_keys(jc), json_keys(je))) as int)
           as schema,
         cast(exact_b as int) as exact
  from (select *, coalesce(ok and ok_e and (case when obj_r and obj_e then
                      list_sort(json_keys(jc)) = list_sort(json_keys(je))
                      and list_bool_and(list_transform(json_keys(je), lambda kk:
                          coalesce(json_extract(jc, '$."' || kk || '"')::varchar
                                   = json_extract(je, '$."' || kk || '"')::varchar, false)))
                    else json(jc)::varchar = json(je)::varchar end), false) as exact_b
        from (select *, coalesce(json_type(jc) = 'OBJECT', false) as obj_r,
                     coalesce(json_type(je) = 'OBJECT', false) as obj_e
              from (select *, case when ok then clean end as jc,
                           case when ok_e then expected end as je
                    from (select *, coalesce(json_valid(clean) and clean <> '', false) as ok,
                                 coalesce(json_valid(expected) and expected <> '', false) as ok_e
                          from (select *, """ + d_fence("response") + """ as clean
                                from json_items) a) b) c) d) e)"""


@register("json_judge_rates", with_fixtures(["json_items"], D_JSON_FLAGS) + """
select checkpoint, count(*) as n,
       round(100.0 * avg(valid::double), 6) as valid_pct,
       round(100.0 * avg(schema::double), 6) as schema_pct,
       round(100.0 * avg(exact::double), 6) as exact_pct
from json_flags group by checkpoint""")
def json_judge_rates(spark, sf_dir):
    """F3b + F1 + F10 + I3: validity, key compliance and exact-match rate per checkpoint."""
    items = fx.json_items(spark, sf_dir)
    return jsonq.judge_json_rates(jsonq.judge_json_flags(items))
