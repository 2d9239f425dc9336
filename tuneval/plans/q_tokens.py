"""Queries for tokenised batches (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render as R
from ..operators import tokens
from ..sources import fixtures as fx
from .catalog import register
from .oracle_fixtures import with_fixtures
from .q_data import _d_body

PAD = tokens.PAD_TOKEN


def _d_words(x):
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda tt: tt <> '')"


D_TOK = f"""tk as (select prompt_id, {_d_words("concat(" + _d_body('instruction', 'input') + ", coalesce(output, ''))")} as t
          from instruct),
enc as (select prompt_id, len(t) as n_tokens, t[1:512] as kept, t as alltok from tk)"""


@register("training_batches", with_fixtures(["instruct"], D_TOK) + f"""
select prompt_id, n_tokens, len(ids) as n_input, cast(list_sum(mask) as bigint) as n_attended,
       md5(array_to_string(ids, ' ')) as input_hash, md5(array_to_string(ids, ' ')) as labels_hash
from (select prompt_id, n_tokens,
             list_concat(list_resize(['{PAD}'][1:0], 512 - len(kept), '{PAD}'), kept) as ids,
             list_concat(list_resize([0][1:0], 512 - len(kept), 0), list_resize([1][1:0], len(kept), 1)) as mask
      from enc) e""")
def training_batches(spark, sf_dir):
    """C1 + K1 + K3: training text tokenised, head-truncated to 512, left-padded, masked."""
    inst = fx.instruct(spark, sf_dir).withColumn(
        "text", R.training_prompt("instruction", "input", "output"))
    e = tokens.encode(inst, "text")
    return e.select("prompt_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.size("input_tokens").cast("bigint").alias("n_input"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint")
                    .alias("n_attended"),
                    F.md5(F.array_join("input_tokens", " ")).alias("input_hash"),
                    F.md5(F.array_join("labels", " ")).alias("labels_hash"))


@register("tail_truncation", with_fixtures(["instruct"], D_TOK) + """
select prompt_id, len(k) as n_kept, md5(array_to_string(k, ' ')) as kept_hash
from (select prompt_id, case when len(alltok) > 0 then alltok[greatest(len(alltok) - 511, 1):] else alltok end as k
      from enc) e""")
def tail_truncation(spark, sf_dir):
    """K2: the last 512 tokens of each training text."""
    inst = fx.instruct(spark, sf_dir).withColumn(
        "text", R.training_prompt("instruction", "input", "output"))
    e = tokens.encode(inst, "text", pad=False, keep="tail")
    return e.select("prompt_id", F.size("input_tokens").cast("bigint").alias("n_kept"),
                    F.md5(F.array_join("input_tokens", " ")).alias("kept_hash"))


@register("length_budget", with_fixtures(["instruct"], D_TOK) + """
select count(*) as rows, count(*) filter (where n_tokens > 512) as rows_over,
       cast(sum(greatest(n_tokens - 512, 0)) as bigint) as tokens_dropped, round(avg(n_tokens), 6) as mean_tokens,
       max(n_tokens) as max_tokens, quantile_disc(n_tokens, 0.5) as p50_tokens
from enc""")
def length_budget(spark, sf_dir):
    """K4: rows over the 512-token budget, tokens dropped, mean/max/median length."""
    inst = fx.instruct(spark, sf_dir).withColumn(
        "text", R.training_prompt("instruction", "input", "output"))
    b = tokens.length_budget(tokens.encode(inst, "text"))
    return b.withColumns({c: F.col(c).cast("bigint") for c in
                          ("tokens_dropped", "max_tokens", "p50_tokens")})


@register("training_steps", with_fixtures(["instruct"]) + """
select e.epochs, count(*) as rows, cast(ceil(count(*) / 16) as bigint) as steps_per_epoch,
       cast(ceil(count(*) / 16) * e.epochs as bigint) as total_steps
from instruct cross join (values (1), (2), (3)) e(epochs) group by e.epochs""")
def training_steps(spark, sf_dir):
    """K5: optimizer steps for batch 2 x accumulation 8 over 1-3 epochs."""
    n = fx.instruct(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))
    e = n.select("rows", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("epochs"))
    return e.select("epochs", "rows", tokens.step_plan(F.col("rows"), 2, 8, 1).alias("steps_per_epoch"),
                    tokens.step_plan(F.col("rows"), 2, 8, F.col("epochs")).alias("total_steps"))
