"""Queries for text similarity and open-ended suite metrics (G, I1, I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import textsim
from ..sources import fixtures as fx
from . import evaluate
from .catalog import d_trim, register
from .oracle_fixtures import with_fixtures


def d_tokens(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '),"
            f" lambda tt: tt <> '')")


def d_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda tt: tt <> ''))"


def d_bigrams(t: str) -> str:
    return (f"case when len({t}) >= 2 then list_transform(range(1, len({t})), "
            f"lambda ii: {t}[ii] || ' ' || {t}[ii + 1]) else [] end")


def d_lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: rows of the
    table, each the running maximum of a step on the row before."""
    return f"""coalesce(list_max(list_reduce(
      list_transform({a}, lambda x: list_transform({b}, lambda y: (x = y)::int)),
      lambda r, e: list_transform([list_transform(range(1, len(r) + 1),
                                   lambda m: greatest(r[m], coalesce(r[m - 1], 0) + e[m]))],
                                  lambda t: list_transform(range(1, len(r) + 1), lambda k: list_max(t[1:k])))[1],
      list_transform({b}, lambda y: 0))), 0)"""


D_ROUGE = """pairs as (
  select r.prompt_id, r.checkpoint, r.response, i.output as reference
  from responses r join instruct i using (prompt_id)),
toks as (select prompt_id, checkpoint, response, """ + d_tokens("response") + """ as tp, """ + \
    d_tokens("reference") + """ as tr from pairs),
grams as (
  select prompt_id, checkpoint, 1 as n, 'p' as side, unnest(tp) as g from toks
  union all select prompt_id, checkpoint, 1, 'r', unnest(tr) from toks
  union all select prompt_id, checkpoint, 2, 'p', unnest(""" + d_bigrams("tp") + """) from toks
  union all select prompt_id, checkpoint, 2, 'r', unnest(""" + d_bigrams("tr") + """) from toks),
ov as (
  select prompt_id, checkpoint, sum(case when n = 1 then least(cp, cr) end) as ov1,
         sum(case when n = 2 then least(cp, cr) end) as ov2
  from (select prompt_id, checkpoint, n, g, count(*) filter (where side = 'p') as cp,
               count(*) filter (where side = 'r') as cr
        from grams group by prompt_id, checkpoint, n, g) c
  group by prompt_id, checkpoint),
rouge as (
  select t.prompt_id, t.checkpoint, t.response,
         case when coalesce(ov1, 0) > 0 then 2.0 * ov1 / (len(tp) + len(tr)) else 0.0 end as rouge1,
         case when coalesce(ov2, 0) > 0 then 2.0 * ov2 / (greatest(len(tp) - 1, 0) + greatest(len(tr) - 1, 0))
              else 0.0 end as rouge2,
         case when """ + d_lcs("tp", "tr") + """ > 0 then 2.0 * """ + d_lcs("tp", "tr") + """ / (len(tp) + len(tr))
              else 0.0 end as "rougeL"
  from toks t left join ov using (prompt_id, checkpoint))"""


def scored_pairs(spark, sf_dir, inst=None, resp=None):
    """Responses with their reference (the expected output) by prompt id."""
    inst = inst if inst is not None else fx.instruct(spark, sf_dir)
    resp = resp if resp is not None else fx.responses(spark, sf_dir, inst)
    return resp.join(inst.select("prompt_id", F.col("output").alias("reference")), "prompt_id")


def open_rows(spark, sf_dir, stem=False, inst=None):
    """Scored rows; prompts and responses are made once for texts and vectors."""
    inst = inst if inst is not None else fx.written_instruct(spark, sf_dir)
    resp = fx.written_responses(spark, sf_dir, inst)
    return evaluate.open_rows(scored_pairs(spark, sf_dir, inst, resp),
                              fx.token_vectors(spark, sf_dir, inst, resp), stem=stem)


OPEN_COLUMNS = ("avg_response_length", "rouge1", "rouge2", "rougeL", "bertscore_f1")


@register("open_suite_metrics", with_fixtures(["responses", "tokens"], D_ROUGE) + f"""
select checkpoint, count(*) as count, round(avg({d_words('response')}), 6) as avg_response_length,
       round(avg(rouge1), 6) as rouge1, round(avg(rouge2), 6) as rouge2, round(avg("rougeL"), 6) as "rougeL",
       round(avg(f), 6) as bertscore_f1
from rouge join bert using (prompt_id, checkpoint) group by checkpoint""")
def open_suite_metrics(spark, sf_dir):
    """I1 + G1 + G2 + G3 + G5: count, mean words, ROUGE-1/2/L (unstemmed) and BERTScore per checkpoint."""
    m = evaluate.open_suite_metrics(open_rows(spark, sf_dir))
    return m.select("checkpoint", "count", *[F.round(c, 6).alias(c) for c in OPEN_COLUMNS])


@register("open_suite_rouge_l")
def open_suite_rouge_l(spark, sf_dir):
    """G3 + G4: mean ROUGE-L plain, and ROUGE-L, -1 and -2 with stemmed tokens as the
    reference's scorer counts them, per checkpoint."""
    plain = textsim.rouge_l(scored_pairs(spark, sf_dir)).groupBy("checkpoint").agg(F.avg("rougeL").alias("plain"))
    m = evaluate.open_suite_metrics(open_rows(spark, sf_dir, stem=True)).join(plain, "checkpoint")
    return m.select("checkpoint", F.round("plain", 6).alias("rougeL"),
                    *[F.round(c, 6).alias(c + "_stemmed") for c in ("rouge1", "rouge2", "rougeL")])


@register("rouge_l_vs_baseline", with_fixtures(["responses"]) + f"""
select checkpoint, round(avg(case when l > 0 then 2.0 * l / (len(tp) + len(tr)) else 0.0 end), 6) as "rougeL_vs_baseline",
       count(*) as n
from (select *, {d_lcs('tp', 'tr')} as l
      from (select a.checkpoint, {d_tokens('a.response')} as tp, {d_tokens('b.response')} as tr
            from responses a join responses b using (prompt_id)
            where a.checkpoint <> 'cp0' and b.checkpoint = 'cp0') t) x
group by checkpoint""")
def rouge_l_vs_baseline(spark, sf_dir):
    """Mean ROUGE-L of cp1/cp2 responses against the cp0 (baseline) response."""
    r = fx.responses(spark, sf_dir)
    base = r.where(F.col("checkpoint") == "cp0").select("prompt_id",
                                                        F.col("response").alias("reference"))
    p = r.where(F.col("checkpoint") != "cp0").join(base, "prompt_id")
    rl = textsim.rouge_l(p, "response", "reference")
    return rl.groupBy("checkpoint").agg(F.round(F.avg("rougeL"), 6).alias("rougeL_vs_baseline"),
                                        F.count(F.lit(1)).alias("n"))


@register("bertscore_pairs", with_fixtures(["tokens"]) + """
select prompt_id, checkpoint, round(p, 6) as bert_precision, round(r, 6) as bert_recall, round(f, 6) as bert_f1
from bert""")
def bertscore_pairs(spark, sf_dir):
    """BERTScore precision/recall/F1 per response from token vectors."""
    b = textsim.bertscore(fx.token_vectors(spark, sf_dir))
    return b.select("prompt_id", "checkpoint", *[F.round(c, 6).alias(c) for c in
                                                 ("bert_precision", "bert_recall", "bert_f1")])


@register("task_completion_rates", with_fixtures(["responses"]) + f"""
select checkpoint, round(avg(case when response is null or length({d_trim('response')}) < 5 then 0.0
                             when {d_words('response')} > 1000 then 0.5 else 1.0 end), 6)
         as task_completion
from responses group by checkpoint""")
def task_completion_rates(spark, sf_dir):
    """Mean task-completion heuristic per checkpoint."""
    r = fx.responses(spark, sf_dir)
    return r.groupBy("checkpoint").agg(
        F.round(F.avg(textsim.task_completion("response")), 6).alias("task_completion"))


@register("length_bands", with_fixtures(["responses"]) + f"""
select checkpoint, case when {d_words('response')} < 20 then 'collapse'
                        when {d_words('response')} > 150 then 'runaway' else 'normal' end as band,
       count(*) as n
from responses group by all""")
def length_bands(spark, sf_dir):
    """Responses per length band (collapse < 20 words, runaway > 150) per checkpoint."""
    r = fx.responses(spark, sf_dir)
    return r.groupBy("checkpoint", textsim.length_band("response").alias("band")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("metric_mean_count", with_fixtures(["responses", "tokens"], D_ROUGE) + f"""
select checkpoint, metric, round(avg(value), 6) as mean, count(value) as count
from (select checkpoint, 'rouge1' as metric, rouge1 as value from rouge
      union all select checkpoint, 'rouge2', rouge2 from rouge
      union all select checkpoint, 'rougeL', "rougeL" from rouge
      union all select checkpoint, 'bertscore_f1', f from bert
      union all select checkpoint, 'words', {d_words('response')}::double from rouge
      union all select checkpoint, 'completion',
        case when length({d_trim('response')}) < 5 then 0.0
             when {d_words('response')} > 1000 then 0.5 else 1.0 end from rouge) u
group by checkpoint, metric""")
def metric_mean_count(spark, sf_dir):
    """I4: per-row metrics unpivoted, then mean and count per checkpoint and metric."""
    long = open_rows(spark, sf_dir).unpivot(
        ["prompt_id", "checkpoint"], ["rouge1", "rouge2", "rougeL", "bertscore_f1", "words", "completion"],
        "metric", "value")
    return long.groupBy("checkpoint", "metric").agg(F.round(F.avg("value"), 6).alias("mean"),
                                                    F.count("value").alias("count"))
