"""Queries for checkpoint comparison, forgetting and ablation (J, I8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import ablation, forgetting, jsonq, sampling, textsim
from ..operators import verdicts as V
from ..session import scratch_path, scratch_table
from ..sources import fixtures as fx
from . import evaluate
from .catalog import D_JSON_FLAGS, register, sq
from .oracle_fixtures import H, with_fixtures
from .q_json import _d_flat_canon_types, _d_schema_cte, items_with_schema
from .q_judge import D_CATEGORY, D_VERDICTS
from .q_text import D_ROUGE, open_rows, scored_pairs

PAIRS = (("cp0", "cp1"), ("cp1", "cp2"))


def tidy_metrics(spark, sf_dir):
    """(checkpoint, metric, value): all metrics of both suites."""
    return evaluate.tidy_metrics(evaluate.open_suite_metrics(open_rows(spark, sf_dir)),
                                 jsonq.suite_metrics(items_with_schema(spark, sf_dir)))


D_METRICS = (D_ROUGE + ",\n" + _d_schema_cte("response") + f""",
jm as (select checkpoint, sum(ok::int) / count(*) as validity_rate,
              sum((ok and compliant)::int) / count(*) as compliance_rate,
              sum(coalesce(ok and obj and {_d_flat_canon_types('jc')} = {_d_flat_canon_types('expected')}, false)::int)
                / count(*) as exact_match_rate
       from sc group by checkpoint),
metrics as (
  select checkpoint, 'rouge1' as metric, avg(rouge1) as value from rouge group by checkpoint
  union all select checkpoint, 'rouge2', avg(rouge2) from rouge group by checkpoint
  union all select checkpoint, 'rougeL', avg("rougeL") from rouge group by checkpoint
  union all select checkpoint, 'bertscore_f1', avg(f) from bert group by checkpoint
  union all select checkpoint, 'validity_rate', validity_rate from jm
  union all select checkpoint, 'compliance_rate', compliance_rate from jm
  union all select checkpoint, 'exact_match_rate', exact_match_rate from jm),
grid as (select * from (values ('cp0', 'cp1'), ('cp1', 'cp2')) p(checkpoint_1, checkpoint_2)
         cross join (values ('rouge1'), ('rouge2'), ('rougeL'), ('bertscore_f1'), ('validity_rate'),
                            ('compliance_rate'), ('exact_match_rate')) m(metric)),
cmp as (
  select g.checkpoint_1, g.checkpoint_2, g.metric, coalesce(a.value, 0) as v1, coalesce(b.value, 0) as v2
  from grid g left join metrics a on a.checkpoint = g.checkpoint_1 and a.metric = g.metric
  left join metrics b on b.checkpoint = g.checkpoint_2 and b.metric = g.metric)""")

D_CMP_SELECT = """select checkpoint_1, checkpoint_2, metric, round(v1, 6) as value_1, round(v2, 6) as value_2,
       round(v2 - v1, 6) as absolute_change,
       round(case when v1 > 0 then (v2 - v1) / v1 * 100 else 0 end, 6) as percent_change from cmp"""


def compare(spark, sf_dir):
    return forgetting.compare_checkpoints(tidy_metrics(spark, sf_dir), PAIRS)


@register("compare_checkpoints", with_fixtures(["responses", "tokens", "json_items"], D_METRICS) + D_CMP_SELECT)
def compare_checkpoints(spark, sf_dir):
    """Per metric, cp0->cp1 and cp1->cp2 values, absolute and percent change."""
    return compare(spark, sf_dir)


@register("retention_gate", with_fixtures(["responses", "tokens", "json_items"], D_METRICS) + """
select checkpoint_1, checkpoint_2, metric, percent_change, percent_change >= -5.0 as passed,
       case when percent_change >= -5.0 then 'ok'
            else printf('%s dropped %.2f%% (limit %.1f%%)', metric, -percent_change, 5.0) end as reason
from (""" + D_CMP_SELECT + """) c where metric in ('rouge1', 'rouge2', 'rougeL', 'bertscore_f1')""")
def retention_gate(spark, sf_dir):
    """Stage-1 (open-ended) metrics may not drop more than 5 %."""
    means = evaluate.open_suite_metrics(open_rows(spark, sf_dir))
    tidy = means.unpivot("checkpoint", list(forgetting.OPEN_METRICS), "metric", "value")
    return forgetting.retention_gate(forgetting.compare_checkpoints(tidy, PAIRS, forgetting.OPEN_METRICS))


def win_table(spark, sf_dir, inst=None):
    return V.win_rates(V.normalize_verdicts(V.parse_verdicts(fx.verdicts(spark, sf_dir, inst))))


D_SEV = """
select round(r1, 6) as cp1_win_rate, round(r2, 6) as cp2_win_rate,
       round(r2 - r1, 6) as judge_wr_abs_change, round(p, 6) as judge_wr_pct_change,
       case when p < -20 then 'severe' when p < -10 then 'moderate' when p < -5 then 'mild' else 'none' end
         as forgetting_severity,
       case when 100 * (r2 - r1) < -15 then 'moderate' when 100 * (r2 - r1) < -5 then 'mild' else 'none' end
         as severity_points
from (select *, case when r1 > 0 then (r2 - r1) / r1 * 100 else 0 end as p
      from (select coalesce(max(case when comparison = 'cp1_vs_cp0' then wr end), 0.5) as r1,
                   coalesce(max(case when comparison = 'cp2_vs_cp0' then wr end), 0.5) as r2
            from (select comparison, round(coalesce(count(*) filter (where winner = 'A')
                         / nullif(count(*) filter (where not is_error), 0), 0), 6) as wr
                  from vn group by comparison) w) a) b"""


@register("forgetting_severity", with_fixtures(["verdicts"], D_VERDICTS) + D_SEV)
def forgetting_severity(spark, sf_dir):
    """J3 + J7 + J17: cp1 and cp2 win rates against cp0, change and severity (percent and points)."""
    s = forgetting.forgetting_summary(win_table(spark, sf_dir),
                                      spark.createDataFrame([], "checkpoint string, metric string, value double"))
    return s.select(*[F.round(c, 6).alias(c) for c in ("cp1_win_rate", "cp2_win_rate",
                                                       "judge_wr_abs_change", "judge_wr_pct_change")],
                    "forgetting_severity", "severity_points")


D_SUMMARY = """
m as (select max(v) filter (where checkpoint = 'cp1' and metric = 'l') as l1, max(v) filter (where checkpoint = 'cp2' and metric = 'l') as l2,
             max(v) filter (where checkpoint = 'cp1' and metric = 'b') as b1, max(v) filter (where checkpoint = 'cp2' and metric = 'b') as b2
      from (select checkpoint, 'l' as metric, avg("rougeL") as v from rouge group by checkpoint
            union all select checkpoint, 'b', avg(f) from bert group by checkpoint) x),
w as (select max(wr) filter (where comparison = 'cp1_vs_cp0') as r1, max(wr) filter (where comparison = 'cp2_vs_cp0') as r2
      from (select comparison, round(coalesce(count(*) filter (where winner = 'A')
                   / nullif(count(*) filter (where not is_error), 0), 0), 6) as wr from vn group by comparison) y),
c as (select category, round(r1, 6) as r1, round(r2, 6) as r2,
             round(case when r1 > 0 then (r2 - r1) / r1 * 100 else 0 end, 6) as p
      from (select c.category,
                   coalesce(count(*) filter (where v.comparison = 'cp1_vs_cp0' and v.winner = 'A')
                     / nullif(count(*) filter (where v.comparison = 'cp1_vs_cp0'), 0), 0) as r1,
                   coalesce(count(*) filter (where v.comparison = 'cp2_vs_cp0' and v.winner = 'A')
                     / nullif(count(*) filter (where v.comparison = 'cp2_vs_cp0'), 0), 0) as r2
            from vn v join cat c using (prompt_id) group by c.category) z),
s as (select *, case when j < -20 then 'severe' when j < -10 then 'moderate' when j < -5 then 'mild' else 'none' end as sev
      from (select *, case when r1 > 0 then (r2 - r1) / r1 * 100 else 0 end as j,
                   case when l1 > 0 then (l2 - l1) / l1 * 100 else 0 end as lp,
                   case when b1 > 0 then (b2 - b1) / b1 * 100 else 0 end as bp from w cross join m) q)
select r1 as cp1_win_rate, r2 as cp2_win_rate, round(j, 6) as judge_wr_pct_change, round(lp, 6) as "rougeL_pct_change",
       round(bp, 6) as bertscore_pct_change, (j < -10 or lp < -5 or bp < -5) as has_catastrophic_forgetting,
       sev as forgetting_severity,
       concat_ws(chr(10),
         case sev when 'none' then """ + sq(forgetting.HEADS["none"]) + """
              else concat(case sev """ + " ".join(f"when '{k}' then {sq(v)}" for k, v in forgetting.HEADS.items() if k != "none") + """ end,
                          printf(' (win rate drop %.1f%%).', j)) end,
         case when sev = 'none' and j > 0 then printf('  Judge win rate improved by %.1f%%: %.2f%% → %.2f%%.', j, 100 * r1, 100 * r2)
              when sev = 'none' then printf('  Judge win rate stable: %.2f%% (minimal change).', 100 * r1)
              else concat(case sev """ + " ".join(f"when '{k}' then {sq(v)}" for k, v in forgetting.DECLINES.items()) + """ end,
                          printf('%.2f%% → %.2f%%.', 100 * r1, 100 * r2)) end,
         '', '  Automatic metrics:',
         printf('  - ROUGE-L: %.3f → %.3f (change: %+.1f%%)', l1, l2, lp),
         printf('  - BERTScore: %.3f → %.3f (change: %+.1f%%)', b1, b2, bp),
         '', '  Per-category impact:',
         (select string_agg(printf('  - %s: %s %+.1f%% (%.2f%% → %.2f%%)', category, case when p < 0 then '↓' else '↑' end,
                                   p, 100 * r1, 100 * r2), chr(10) order by category) from c),
         '', case sev when 'none' then """ + sq(forgetting.CONCLUSION_NONE) + """
             else concat(""" + sq(forgetting.CONCLUSION_START) + ", sev, " + sq(forgetting.CONCLUSION_END) + """) end) as summary
from s"""


@register("forgetting_summary", with_fixtures(["responses", "verdicts", "tokens"],
                                              D_ROUGE + ",\n" + D_VERDICTS + ",\n" + D_CATEGORY + ",") + D_SUMMARY)
def forgetting_summary(spark, sf_dir):
    """J2 + J3 + J6: forgetting flag, severity and findings text from judge
    win rates, ROUGE-L, BERTScore and the win rates per category."""
    inst = fx.written_instruct(spark, sf_dir)
    v = evaluate.materialize(V.normalize_verdicts(V.parse_verdicts(fx.verdicts(spark, sf_dir, inst))))
    m = evaluate.open_suite_metrics(open_rows(spark, sf_dir, inst=inst)).unpivot(
        "checkpoint", ["rougeL", "bertscore_f1"], "metric", "value")
    s = forgetting.forgetting_summary(V.win_rates(v), m, evaluate.category_win_rates(v, fx.categories(inst)))
    return s.select("cp1_win_rate", "cp2_win_rate",
                    *[F.round(c, 6).alias(c) for c in ("judge_wr_pct_change", "rougeL_pct_change",
                                                       "bertscore_pct_change")],
                    "has_catastrophic_forgetting", "forgetting_severity",
                    F.array_join("summary", "\n").alias("summary"))


D_CHANGES = D_VERDICTS + ",\n" + D_CATEGORY + """,
sides as (select comparison, prompt_id, is_error, winner,
                 case when len(list_filter(raw_a, lambda x: x is not null)) > 0
                      then list_avg(list_filter(raw_a, lambda x: x is not null)) end as score
          from vn),
chg as (
  select a.prompt_id, coalesce(c.category, 'unknown') as category, a.winner as cp1_winner,
         b.winner as cp2_winner, a.score as cp1_score, b.score as cp2_score, b.score - a.score as change,
         case when a.is_error or b.is_error then null when b.score - a.score < -0.5 then 'regressed'
              when b.score - a.score > 0.5 then 'improved' else 'maintained' end as direction
  from sides a join sides b on a.prompt_id = b.prompt_id
  left join cat c on c.prompt_id = a.prompt_id
  where a.comparison = 'cp1_vs_cp0' and b.comparison = 'cp2_vs_cp0')"""


def changes(spark, sf_dir):
    inst = fx.instruct(spark, sf_dir)
    v = evaluate.materialize(V.normalize_verdicts(V.parse_verdicts(fx.verdicts(spark, sf_dir, inst))))
    return forgetting.aligned_changes(v, fx.categories(inst))


@register("regression_examples", with_fixtures(["verdicts"], D_CHANGES) + """
select prompt_id, category, direction, round(change, 6) as change, rank
from (select *, row_number() over (partition by direction
               order by case when direction = 'improved' then -change else change end, prompt_id) as rank
      from chg where direction in ('regressed', 'improved')) r
where rank <= 5""")
def regression_examples(spark, sf_dir):
    """E4 + H11 + J4 + J5: five largest regressions and improvements (cp2 vs cp1 over cp0)."""
    t = forgetting.top_examples(changes(spark, sf_dir), 5)
    return t.select("prompt_id", "category", "direction", F.round("change", 6).alias("change"),
                    F.col("rank").cast("bigint").alias("rank"))


@register("example_buckets", with_fixtures(["verdicts"], D_CHANGES) + """
select direction as bucket, prompt_id, round(change, 6) as change, bucket_size
from (select *, row_number() over (partition by direction order by prompt_id) as rn,
             count(*) over (partition by direction) as bucket_size
      from chg where direction is not null) x where rn = 1""")
def example_buckets(spark, sf_dir):
    """One example per maintained/improved/regressed bucket and the bucket sizes."""
    b = forgetting.example_buckets(changes(spark, sf_dir))
    return b.select("bucket", "prompt_id", F.round("change", 6).alias("change"), "bucket_size")


# ------------------------------------------------------------------ ablation
# The runs that are compared are real groups of the scored items: a stage of
# training is a checkpoint, a data size a hash sample of the items, a variant
# of the task an event type, and an approach a pair of checkpoints.
STAGES = (("stage_0", "cp0", 0), ("stage_1", "cp1", 1), ("stage_2", "cp2", 2))
SIZES = (100, 50, 25)
APPROACHES = (("sequential", "cp1"), ("combined", "cp0"))   # cp2 against this base
ROW = "ablation_type string, variant_name string, stage2_epochs int, stage2_dataset_size_pct double, training_approach string"


def ablation_results(spark, sf_dir):
    # read a dozen times, a few columns each
    flags = scratch_table(jsonq.judge_json_flags(fx.json_items(spark, sf_dir)).select(
        "prompt_id", "checkpoint", "task_type", "valid", "schema", "exact"), "flags")
    names = [("epochs", v, n, 100.0, "sequential") for v, _, n in STAGES]
    names += [("dataset_size", f"datasize_{p}pct", 2, float(p), "sequential") for p in SIZES]
    names += [("sequential_vs_combined", a, 2, 100.0, a) for a, _ in APPROACHES]
    configs = spark.createDataFrame(names, ROW).unionByName(
        flags.select("task_type").distinct().select(
            F.lit("task").alias("ablation_type"), F.concat(F.lit("task_"), "task_type").alias("variant_name"),
            F.lit(2).alias("stage2_epochs"), F.lit(100.0).alias("stage2_dataset_size_pct"),
            F.lit("sequential").alias("training_approach")))

    def of(cp):
        return flags.where(F.col("checkpoint") == cp)

    def named(d, name):
        return d.select((F.lit(name) if isinstance(name, str) else name).alias("variant_name"),
                        "prompt_id", "valid", "schema", "exact")
    task = F.concat(F.lit("task_"), "task_type")
    parts = [named(of(cp), v) for v, cp, _ in STAGES] + [named(of("cp2"), task)]
    parts += [named(sampling.fraction_sample(of("cp2"), p / 100), f"datasize_{p}pct") for p in SIZES]
    parts += [named(of("cp2"), a) for a, _ in APPROACHES]
    base = [named(of(cp), a) for a, cp in APPROACHES] + [named(of("cp1"), v) for v, _, n in STAGES if n == 2]
    wins = win_table(spark, sf_dir).select(F.col("comparison"), F.col("win_rate_a").alias("win_rate"))
    stage = F.create_map(F.lit("cp1_vs_cp0"), F.lit("stage_1"), F.lit("cp2_vs_cp0"), F.lit("stage_2"))
    wins = wins.select(F.element_at(stage, F.col("comparison")).alias("variant_name"), "win_rate") \
               .where(F.col("variant_name").isNotNull())
    return ablation.results_from_flags(reduce(DataFrame.unionByName, parts), configs,
                                       reduce(DataFrame.unionByName, base), wins)


D_SAMPLE = "(select * from cp2 qualify row_number() over (order by " + H("concat_ws(':', '42', cast(prompt_id as varchar))") + \
    ", prompt_id) <= greatest(1, floor(count(*) over () * {f})))"
D_ABL = D_VERDICTS + ",\n" + D_JSON_FLAGS + """,
cp2 as (select * from json_flags where checkpoint = 'cp2'),
runs as (
  select 'stage_' || right(checkpoint, 1) as variant_name, 'epochs' as ablation_type, right(checkpoint, 1)::int as stage2_epochs,
         100.0::double as stage2_dataset_size_pct, 'sequential' as training_approach, valid, schema, exact from json_flags
  union all select 'task_' || task_type, 'task', 2, 100.0, 'sequential', valid, schema, exact from cp2
""" + "".join(f"""  union all select 'datasize_{p}pct', 'dataset_size', 2, {p}.0, 'sequential', valid, schema, exact
  from {"cp2" if p == 100 else D_SAMPLE.format(f=p / 100)}
""" for p in SIZES) + "".join(f"""  union all select '{a}', 'sequential_vs_combined', 2, 100.0, '{a}', valid, schema, exact from cp2
""" for a, _ in APPROACHES) + """),
vm as (select ablation_type, variant_name, stage2_epochs, stage2_dataset_size_pct, training_approach,
              avg(valid) as json_validity_rate, avg(schema) as json_compliance_rate, avg(exact) as json_exact_match_rate
       from runs group by all),
bases as (select 'stage_2' as variant_name, avg(exact) as base from json_flags where checkpoint = 'cp1'
""" + "".join(f"          union all select '{a}', avg(exact) from json_flags where checkpoint = '{cp}'\n" for a, cp in APPROACHES) + """),
wr as (select case comparison when 'cp1_vs_cp0' then 'stage_1' when 'cp2_vs_cp0' then 'stage_2' end as variant_name,
              round(coalesce(count(*) filter (where winner = 'A') / nullif(count(*) filter (where not is_error), 0), 0), 6)
                as alpaca_judge_win_rate from vn group by comparison),
res as (select *, json_exact_match_rate as primary_metric,
               case when base is null then null when p < -20 then 'severe' when p < -10 then 'moderate' when p < -5 then 'mild'
                    else 'none' end as forgetting_severity
        from (select vm.*, base, alpaca_judge_win_rate,
                     case when base > 0 then (json_exact_match_rate - base) / base * 100 else 0 end as p
              from vm left join bases using (variant_name) left join wr using (variant_name)) x)"""


@register("ablation_report", with_fixtures(["verdicts", "json_items"], D_ABL) + """
select ablation_type, variant_name,
       case when json_exact_match_rate is null then 'N/A' else printf('%.1f%%', json_exact_match_rate * 100) end as json_acc,
       case when alpaca_judge_win_rate is null then 'N/A' else printf('%.1f%%', alpaca_judge_win_rate * 100) end as alpaca_wr,
       coalesce(forgetting_severity, 'N/A') as forgetting,
       case when primary_metric is null then 'N/A' else printf('%.3f', primary_metric) end as primary
from res""")
def ablation_report(spark, sf_dir):
    """One report line per run (stages, data sizes, tasks, approaches)."""
    return ablation.report(ablation_results(spark, sf_dir))


@register("ablation_findings", with_fixtures(["verdicts", "json_items"], D_ABL) + """
select (select round(max_by(primary_metric, coalesce(stage2_epochs, 0)) - min_by(primary_metric, coalesce(stage2_epochs, 0)), 6)
        from res where ablation_type = 'epochs') as trend,
       (select max_by(variant_name, (primary_metric, variant_name)) from res
        where ablation_type = 'task' and primary_metric is not null) as best_variant,
       (select max(case when training_approach = 'sequential' then forgetting_severity end) from res
        where ablation_type = 'sequential_vs_combined') as sequential_forgetting,
       (select max(case when training_approach = 'combined' then forgetting_severity end) from res
        where ablation_type = 'sequential_vs_combined') as combined_forgetting""")
def ablation_findings(spark, sf_dir):
    """J11 + J12 + J14: trend over stages, best task, sequential vs combined."""
    r = evaluate.materialize(ablation_results(spark, sf_dir))
    t = ablation.epoch_trend(r).withColumn("_k", F.lit(1))
    b = ablation.best_variant(r, "task").select("best_variant").withColumn("_k", F.lit(1))
    a = ablation.approach_comparison(r).withColumn("_k", F.lit(1))
    # three single-row aggregates joined on a constant key
    return t.join(b, "_k").join(a, "_k").drop("_k")


@register("ablation_size_effect", with_fixtures(["verdicts", "json_items"], D_ABL) + """
select cast(lag(stage2_dataset_size_pct) over w as double) as from_pct,
       cast(stage2_dataset_size_pct as double) as to_pct,
       round(lag(json_exact_match_rate) over w, 6) as from_rate, round(json_exact_match_rate, 6) as to_rate
from res where ablation_type = 'dataset_size'
window w as (order by stage2_dataset_size_pct desc)
qualify lag(stage2_dataset_size_pct) over w is not null""")
def ablation_size_effect(spark, sf_dir):
    """Exact-match rate between adjacent dataset sizes (largest first)."""
    return ablation.size_effect(evaluate.materialize(ablation_results(spark, sf_dir)))


D_CHECKPOINTS = """
select checkpoint, round(validity_rate, 6) as validity_rate, round(compliance_rate, 6) as compliance_rate,
       round(exact_match_rate, 6) as exact_match_rate, round("rougeL", 6) as "rougeL",
       round(bertscore_f1, 6) as bertscore_f1, round(coalesce(wr, 0), 6) as judge_win_rate
from jm join (select checkpoint, avg("rougeL") as "rougeL" from rouge group by checkpoint) r using (checkpoint)
join (select checkpoint, avg(f) as bertscore_f1 from bert group by checkpoint) b using (checkpoint)
left join (select left(comparison, 3) as checkpoint, round(coalesce(count(*) filter (where winner = 'A')
             / nullif(count(*) filter (where not is_error), 0), 0), 6) as wr
           from vn where comparison like '%_vs_cp0' group by comparison) w using (checkpoint)"""


def evaluated(spark, sf_dir):
    inst = fx.written_instruct(spark, sf_dir)
    resp = fx.written_responses(spark, sf_dir, inst)
    return evaluate.evaluate(inst, resp, items_with_schema(spark, sf_dir),
                             fx.verdicts(spark, sf_dir, inst), fx.token_vectors(spark, sf_dir, inst, resp),
                             fx.categories(inst))


@register("checkpoint_summary", with_fixtures(["responses", "tokens", "json_items", "verdicts"],
                                              D_METRICS + ",\n" + D_VERDICTS) + D_CHECKPOINTS)
def checkpoint_summary(spark, sf_dir):
    """I8 + I10: the composed evaluation's three-checkpoint table (validity,
    compliance, exact match, ROUGE-L, BERTScore, judge win rate)."""
    return evaluated(spark, sf_dir)["checkpoints"]


@register("evaluation_reports", with_fixtures(["responses", "tokens", "json_items", "verdicts"],
                                              D_METRICS + ",\n" + D_VERDICTS) + D_CHECKPOINTS)
def evaluation_reports(spark, sf_dir):
    """A10 + I10: all reports of the evaluation written as tables, the checkpoint table read back."""
    paths = evaluate.write_reports(evaluated(spark, sf_dir), scratch_path(spark, "reports"))
    return spark.read.parquet(paths["checkpoints"])
