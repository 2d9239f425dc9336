"""Queries for structured-output quality (F, I2, I5, I7, J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fence_strip_prefix
from ..functions import jsonfn as J
from ..operators import jsonq
from ..operators.reports import value_counts
from ..sources import fixtures as fx
from .catalog import D_JSON_FLAGS, d_fence, d_trim, register
from .oracle_fixtures import with_fixtures


def items_with_schema(spark, sf_dir):
    return fx.json_items(spark, sf_dir).withColumn("schema", fx.json_schema_spec())


# DuckDB: strict parse flags and schema checks of the fixture's spec
# (required event_type/k/user_id; string/number/number; bool passes as number).
def _d_schema_cte(text_expr: str) -> str:
    return f"""sc as (
  select *, coalesce(obj and not missing and not type_err, false) as compliant
  from (select *,
          (obj and (list_position(json_keys(jc), 'event_type') is null
                    or list_position(json_keys(jc), 'k') is null
                    or list_position(json_keys(jc), 'user_id') is null)) as missing,
          (obj and (coalesce(json_type(jc, '$.event_type') <> 'VARCHAR', false)
                    or coalesce(json_type(jc, '$.k') not in ('BIGINT','UBIGINT','DOUBLE','BOOLEAN'), false)
                    or coalesce(json_type(jc, '$.user_id') not in ('BIGINT','UBIGINT','DOUBLE','BOOLEAN'), false)))
            as type_err
        from (select *, coalesce(json_type(jc) = 'OBJECT', false) as obj
              from (select *, case when ok then t end as jc
                    from (select *, coalesce(t <> '' and json_valid(t), false) as ok
                          from (select *, {text_expr} as t from json_items) a) b) c) d) e)"""


def _d_flat_canon_types(x: str) -> str:
    return (f"list_transform(list_sort(json_keys({x})), lambda kk: concat(kk, '=', "
            f"json_extract({x}, '$.\"' || kk || '\"')::varchar, ':', json_type({x}, '$.\"' || kk || '\"')))")


@register("json_suite_metrics", with_fixtures(["json_items"], _d_schema_cte("response")) + f"""
select checkpoint, count(*) as count,
       round(sum(ok::int) / count(*), 6) as validity_rate,
       round(sum((ok and compliant)::int) / count(*), 6) as compliance_rate,
       round(sum(exact::int) / count(*), 6) as exact_match_rate,
       round(coalesce(sum((ok and compliant)::int) / nullif(sum(ok::int), 0), 0), 6)
         as compliance_of_valid
from (select *, coalesce(ok and obj and {_d_flat_canon_types('jc')} = {_d_flat_canon_types('expected')},
                         false) as exact from sc) x
group by checkpoint""")
def json_suite_metrics(spark, sf_dir):
    """I2 (F1, F6, F8, F9, F11): validity, schema compliance and exact-match rates."""
    return jsonq.suite_metrics(items_with_schema(spark, sf_dir))


# What Python's parser says of the stand-in's invalid shapes: no JSON start
# (empty, prose, fences), a quote it does not know, an object cut short.
D_CLASSES = """
select checkpoint, error_class, count(*) as n
from (select checkpoint, case when t = '' or not regexp_matches(t, '^[\\[{{"0-9tfn-]') then 'invalid_value'
             when starts_with(t, '{{' || chr(39)) then '{key}'
             when starts_with(t, '{{') then 'missing_comma' end as error_class
      from (select checkpoint, {text} as t from json_items) a
      where t = '' or not coalesce(json_valid(t), false)) b
group by checkpoint, error_class"""


@register("json_error_taxonomy", with_fixtures(["json_items"]) + D_CLASSES.format(
    key="missing_colon_or_key", text=d_trim("response")))
def json_error_taxonomy(spark, sf_dir):
    """Invalid outputs (stripped) per parser-message class and checkpoint."""
    return jsonq.error_taxonomy(fx.json_items(spark, sf_dir), form="detailed")


@register("json_error_taxonomy_inline", with_fixtures(["json_items"]) + D_CLASSES.format(
    key="missing_key", text="response"))
def json_error_taxonomy_inline(spark, sf_dir):
    """Invalid outputs (raw) per 5-class parser-message code and checkpoint."""
    return jsonq.error_taxonomy(fx.json_items(spark, sf_dir), form="inline")


def _d_cnt(x, ch):
    return f"(length({x}) - length(replace({x}, '{ch}', '')))"


D_REPORT = _d_schema_cte(d_fence("response")) + f""",
rep as (
  select *, case
    when t = '' then 'empty'
    when not ok then case
      when regexp_matches(t, ',\\s*[}}\\]]') then 'trailing_comma'
      when regexp_matches(t, '''''[^'']*''\\s*:|:\\s*''') then 'quote_mismatch'
      when (starts_with(t, '{{') or starts_with(t, '[')) and
           ({_d_cnt('t', '{')} > {_d_cnt('t', '}')} or {_d_cnt('t', '[')} > {_d_cnt('t', ']')})
        then 'truncated'
      when not (starts_with(t, '{{') or starts_with(t, '[')) and
           ({_d_cnt('t', '{')} > 0 or {_d_cnt('t', '[')} > 0) then 'wrapped_text'
      when not (starts_with(t, '{{') or starts_with(t, '[')) or
           {_d_cnt('t', '{')} <> {_d_cnt('t', '}')} or {_d_cnt('t', '[')} <> {_d_cnt('t', ']')}
        then 'missing_brackets'
      else 'other_invalid' end
    when type_err then 'type_error'
    when missing then 'missing_fields'
    when obj and len(list_filter(json_keys(jc), lambda kk: kk not in ('event_type', 'k', 'user_id'))) > 0
      then 'extra_fields'
  end as report_class from sc)"""


@register("json_report_taxonomy", with_fixtures(["json_items"], D_REPORT) + """
select checkpoint, report_class, count(*) as n from rep group by checkpoint, report_class""")
def json_report_taxonomy(spark, sf_dir):
    """Report error classes (brackets, quotes, truncation, types, fields) per
    checkpoint; the NULL class counts clean rows."""
    r = jsonq.report_taxonomy(items_with_schema(spark, sf_dir))
    return r.groupBy("checkpoint", "report_class").agg(F.count(F.lit(1)).alias("n"))


@register("json_error_resolution", with_fixtures(["json_items"], D_REPORT) + """
select report_class, count(*) filter (where checkpoint = 'cp0') as n_before,
       count(*) filter (where checkpoint = 'cp2') as n_after,
       round(case when count(*) filter (where checkpoint = 'cp0') > 0 then
         (count(*) filter (where checkpoint = 'cp0') - count(*) filter (where checkpoint = 'cp2'))
         / count(*) filter (where checkpoint = 'cp0') end, 6) as resolution
from rep group by report_class""")
def json_error_resolution(spark, sf_dir):
    """Per report error class, cp0 vs cp2 counts and the share resolved."""
    return jsonq.error_resolution(jsonq.report_taxonomy(items_with_schema(spark, sf_dir)))


def _d_pairs(x):
    return (f"coalesce(case when json_type({x}) = 'OBJECT' then list_transform(json_keys({x}), "
            f"lambda kk: concat(kk, chr(1), json_extract({x}, '$.\"' || kk || '\"')::varchar)) end, [])")


@register("json_field_f1", with_fixtures(["json_items"]) + f"""
select checkpoint, round(avg(f1), 6) as mean_field_f1, round(avg(p), 6) as mean_precision,
       round(avg(r), 6) as mean_recall
from (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f1
      from (select *, case when len(pp) > 0 then len(list_intersect(pp, ee)) / len(pp) else 0.0 end as p,
                   case when len(ee) > 0 then len(list_intersect(pp, ee)) / len(ee) else 0.0 end as r
            from (select checkpoint, {_d_pairs('jc')} as pp, {_d_pairs('expected')} as ee
                  from (select *, case when t <> '' and json_valid(t) then t end as jc
                        from (select *, {d_fence('response')} as t from json_items) a) b) c) d) e
group by checkpoint""")
def json_field_f1(spark, sf_dir):
    """mean field-level precision, recall and F1 per checkpoint."""
    f = jsonq.field_f1(fx.json_items(spark, sf_dir))
    return f.groupBy("checkpoint").agg(F.round(F.avg("field_f1"), 6).alias("mean_field_f1"),
                                       F.round(F.avg("field_precision"), 6).alias("mean_precision"),
                                       F.round(F.avg("field_recall"), 6).alias("mean_recall"))


@register("json_brace_balance", with_fixtures(["json_items"]) + f"""
select checkpoint,
       count(*) filter (where {_d_cnt('response', '{')} <> {_d_cnt('response', '}')}) as unbalanced_braces,
       count(*) filter (where {_d_cnt('response', '[')} <> {_d_cnt('response', ']')}) as unbalanced_brackets
from json_items group by checkpoint""")
def json_brace_balance(spark, sf_dir):
    """outputs whose brace or bracket counts do not balance, per checkpoint."""
    b = jsonq.brace_balance(fx.json_items(spark, sf_dir))
    return b.groupBy("checkpoint").agg(
        F.count(F.when(F.col("open_braces") != F.col("close_braces"), 1)).alias("unbalanced_braces"),
        F.count(F.when(F.col("open_brackets") != F.col("close_brackets"), 1))
         .alias("unbalanced_brackets"))


@register("json_prefix_fence_valid", with_fixtures(["json_items"]) + """
select checkpoint, count(*) filter (where t <> '' and coalesce(json_valid(t), false)) as valid
from (select checkpoint,
             case when starts_with(response, '```json') then
                    case when length(response) - 10 > 0 then substr(response, 8, length(response) - 10) else '' end
                  when starts_with(response, '```') then
                    case when length(response) - 6 > 0 then substr(response, 4, length(response) - 6) else '' end
                  else response end as t
      from json_items) x
group by checkpoint""")
def json_prefix_fence_valid(spark, sf_dir):
    """F3a + F1: outputs valid after the blind prefix/suffix fence slicing."""
    i = fx.json_items(spark, sf_dir).withColumn("t", fence_strip_prefix("response"))
    return i.groupBy("checkpoint").agg(F.count(F.when(J.strict_valid("t"), 1)).alias("valid"))


@register("task_type_counts", with_fixtures(["json_items"]) + """
select task_type, count(*) as n from json_items where checkpoint = 'cp0' group by task_type""")
def task_type_counts(spark, sf_dir):
    """Prompts per task type."""
    return value_counts(fx.json_items(spark, sf_dir).where(F.col("checkpoint") == "cp0"),
                        "task_type")


@register("json_rates_by_task", with_fixtures(["json_items"], D_JSON_FLAGS) + """
select checkpoint, task_type, grouping(checkpoint, task_type) as level, count(*) as n,
       round(100.0 * avg(valid::double), 6) as valid_pct,
       round(100.0 * avg(schema::double), 6) as schema_pct,
       round(100.0 * avg(exact::double), 6) as exact_pct
from json_flags group by grouping sets ((checkpoint, task_type), (checkpoint), ())""")
def json_rates_by_task(spark, sf_dir):
    """JSON rates per (checkpoint, task), per checkpoint and overall (grouping sets)."""
    return jsonq.rates_by_task(jsonq.judge_json_flags(fx.json_items(spark, sf_dir)))
