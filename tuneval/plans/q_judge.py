"""Queries for judge verdicts and pairwise evaluation (H, I6, I9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdicts as V
from ..plans import evaluate
from ..sources import fixtures as fx
from ..schemas import COMPARISONS, DIMENSIONS
from .catalog import register
from .oracle_fixtures import with_fixtures


def normalized(spark, sf_dir, inst=None):
    return V.normalize_verdicts(V.parse_verdicts(fx.verdicts(spark, sf_dir, inst)))


def _d_side(side_json: str) -> str:
    def dim(d):
        x = f"json_extract(j, '$.{side_json}.{d}')"
        num = (f"case when json_type({x}) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') then {x}::double "
               f"when json_type({x}) = 'VARCHAR' and regexp_matches({x}->>'$', '^ *[+-]?[0-9]+ *$') "
               f"then ({x}->>'$')::double end")
        return (f"case when {x} is null then 3 when ({num}) is null then null "
                f"else cast(least(5, greatest(1, trunc({num}))) as int) end")
    return ", ".join(dim(d) for d in DIMENSIONS)


def _d_raw(side_json: str) -> str:
    return ", ".join(
        f"case when json_type(json_extract(j, '$.{side_json}.{d}')) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') "
        f"then json_extract(j, '$.{side_json}.{d}')::double end" for d in DIMENSIONS)


D_VERDICTS = """vp as (
  select *, case when json_type(jtxt) = 'OBJECT' then jtxt end as j
  from (select *, case when ok1 then raw when coalesce(json_valid(sl) and sl <> '', false) then sl end as jtxt
        from (select *, coalesce(json_valid(raw) and raw <> '', false) as ok1,
                     case when strpos(raw, '{') > 0 and strpos(reverse(raw), '}') > 0
                           and length(raw) - strpos(reverse(raw), '}') + 1 > strpos(raw, '{')
                          then substr(raw, strpos(raw, '{'),
                                      length(raw) - strpos(reverse(raw), '}') + 2 - strpos(raw, '{'))
                     end as sl
              from verdicts) a) b),
vn as (
  select comparison, prompt_id, swap, bad as is_error,
         case when bad then null
              when swap = 1 and wn = 'A' then 'B' when swap = 1 and wn = 'B' then 'A' else wn end as winner,
         case when not bad then case when swap = 1 then sb else sa end end as scores_a,
         case when not bad then case when swap = 1 then sa else sb end end as scores_b,
         case when swap = 1 then rb else ra end as raw_a,
         case when swap = 1 then ra else rb end as raw_b
  from (select *, j is null or coalesce(list_bool_or(list_transform(list_concat(sa, sb), lambda x: x is null)), false) as bad
  from (select *, case when json_extract_string(j, '$.winner') in ('A', 'B', 'TIE')
                       then json_extract_string(j, '$.winner') else 'TIE' end as wn,
               case when json_extract(j, '$.response_a_scores') is not null then
                 [""" + _d_side("response_a_scores") + """] end as sa,
               case when json_extract(j, '$.response_b_scores') is not null then
                 [""" + _d_side("response_b_scores") + """] end as sb,
               [""" + _d_raw("response_a_scores") + """] as ra,
               [""" + _d_raw("response_b_scores") + """] as rb
        from vp) x) x2)"""


@register("verdicts_parsed", with_fixtures(["verdicts"], D_VERDICTS) + """
select comparison, prompt_id, cast(is_error as int) as is_error, winner,
       round(list_avg(scores_a), 6) as mean_a, round(list_avg(scores_b), 6) as mean_b
from vn""")
def verdicts_parsed(spark, sf_dir):
    """Parsed, clamped, winner-normalised and unswapped verdicts."""
    v = normalized(spark, sf_dir)
    return v.select("comparison", "prompt_id", F.col("error").isNotNull().cast("int").alias("is_error"),
                    "winner", F.round(V.row_mean(F.col("scores_a")), 6).alias("mean_a"),
                    F.round(V.row_mean(F.col("scores_b")), 6).alias("mean_b"))


D_WINS = """
select comparison, count(*) filter (where not is_error) as total_pairs,
       count(*) filter (where is_error) as error_count,
       count(*) filter (where winner = 'A') as challenger_wins,
       round(coalesce(count(*) filter (where winner = 'A') / nullif(count(*) filter (where not is_error), 0), 0), 6) as win_rate_a,
       round(coalesce(count(*) filter (where winner = 'B') / nullif(count(*) filter (where not is_error), 0), 0), 6) as win_rate_b,
       round(coalesce(count(*) filter (where winner = 'TIE') / nullif(count(*) filter (where not is_error), 0), 0), 6) as tie_rate,
       cast(coalesce(floor(100 * count(*) filter (where winner = 'A') / nullif(count(*) filter (where not is_error), 0)), 0) as bigint) as pct_a,
       cast(coalesce(floor(100 * count(*) filter (where winner = 'B') / nullif(count(*) filter (where not is_error), 0)), 0) as bigint) as pct_b,
       cast(coalesce(floor(100 * count(*) filter (where winner = 'TIE') / nullif(count(*) filter (where not is_error), 0)), 0) as bigint) as pct_tie
from {src} group by comparison"""


@register("judge_win_rates", with_fixtures(["verdicts"], D_VERDICTS) + D_WINS.format(src="vn"))
def judge_win_rates(spark, sf_dir):
    """win/tie rates, errors and challenger wins per comparison."""
    return V.win_rates(normalized(spark, sf_dir))


@register("judge_dimension_averages", with_fixtures(["verdicts"], D_VERDICTS) + f"""
select comparison, dimension, round(coalesce(avg(a), 0), 6) as response_a_mean,
       round(coalesce(avg(b), 0), 6) as response_b_mean
from (select comparison, unnest({[d for d in DIMENSIONS]}) as dimension, unnest(raw_a) as a,
             unnest(raw_b) as b
      from vn where not is_error) u
group by comparison, dimension""")
def judge_dimension_averages(spark, sf_dir):
    """H7: mean raw score per dimension for each side, per comparison."""
    return V.dimension_averages(normalized(spark, sf_dir))


D_CATEGORY = """cat as (select prompt_id, case when input <> '' then 'contextual' else 'open_qa' end as category
                from instruct)"""


@register("category_win_rates", with_fixtures(["verdicts"], D_VERDICTS + ",\n" + D_CATEGORY) + """
select category, round(r1, 6) as cp1_win_rate, round(r2, 6) as cp2_win_rate,
       round(r2 - r1, 6) as absolute_change,
       round(case when r1 > 0 then (r2 - r1) / r1 * 100 else 0 end, 6) as percent_change,
       t1 as total_examples
from (select c.category,
             coalesce(count(*) filter (where v.comparison = 'cp1_vs_cp0' and v.winner = 'A')
               / nullif(count(*) filter (where v.comparison = 'cp1_vs_cp0'), 0), 0) as r1,
             coalesce(count(*) filter (where v.comparison = 'cp2_vs_cp0' and v.winner = 'A')
               / nullif(count(*) filter (where v.comparison = 'cp2_vs_cp0'), 0), 0) as r2,
             count(*) filter (where v.comparison = 'cp1_vs_cp0') as t1
      from vn v join cat c using (prompt_id) group by c.category) x""")
def category_win_rates(spark, sf_dir):
    """E3 + I6: per-category win rates of cp1 and cp2 against cp0 and their change."""
    inst = fx.instruct(spark, sf_dir)
    v = normalized(spark, sf_dir, inst)
    return evaluate.category_win_rates(v, fx.categories(inst))


D_COMPARISONS = "(values " + ", ".join(str(c) for c in COMPARISONS) + ") c(comparison, challenger, opponent)"


@register("pairwise_eval", with_fixtures(["responses", "verdicts"], D_VERDICTS) + """,
pairs as (select c.comparison, a.prompt_id from responses a join responses b using (prompt_id)
          join """ + D_COMPARISONS + """ on a.checkpoint = c.challenger and b.checkpoint = c.opponent
          qualify row_number() over (partition by c.comparison order by """ + """cast('0x' || substr(md5(concat_ws(':', '42', cast(a.prompt_id as varchar))), 1, 8) as bigint), a.prompt_id) <= 100)
""" + D_WINS.format(src="(select v.* from vn v join pairs p using (comparison, prompt_id)) s"))
def pairwise_eval(spark, sf_dir):
    """The pairs of every comparison (E8), 100 of each sampled by hash (D5),
    verdicts joined by (comparison, prompt id), unswapped and aggregated (H6)."""
    inst = fx.instruct(spark, sf_dir)
    return evaluate.pairwise_eval(fx.responses(spark, sf_dir, inst), fx.verdicts(spark, sf_dir, inst),
                                  sample_size=100)
