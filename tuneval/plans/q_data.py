"""Queries for normalisation, templates, sampling and alignment (B, C, D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render as R
from ..functions.hashing import seeded_order_key
from ..functions.text import truncate
from ..operators import align, normalize, render, sampling
from ..sources import fixtures as fx
from ..sources.tables import table
from .catalog import d_trim, register, sq
from .oracle_fixtures import H, with_fixtures

NL = "chr(10)"
EMPTY = "''"


def d_hash_key(seed: str, *cols) -> str:
    return H("concat_ws(':', " + ", ".join([sq(seed)] + [f"cast({c} as varchar)" for c in cols])
             + ")")


# ------------------------------------------------------------------ B
@register("instruct_normalized", with_fixtures(["instruct"]) + f"""
select prompt_id, coalesce(instruction, '') as instruction,
       {d_trim("coalesce(input, '')")} as input, coalesce(output, '') as output
from instruct""")
def instruct_normalized(spark, sf_dir):
    """Records with missing fields as '', input stripped, columns pruned."""
    return normalize.normalize_records(fx.instruct(spark, sf_dir))


@register("responses_first_n", with_fixtures(["responses"]) + """
select suite, prompt_id, checkpoint, response from responses
qualify row_number() over (partition by checkpoint order by prompt_id) <= 30""")
def responses_first_n(spark, sf_dir):
    """First 30 prompts per checkpoint in id order."""
    return normalize.prefix_take(fx.responses(spark, sf_dir), 30)


@register("responses_fraction_prefix", with_fixtures(["responses"]) + """
select suite, prompt_id, checkpoint, response from responses
qualify row_number() over (partition by checkpoint order by prompt_id)
        <= floor(count(*) over (partition by checkpoint) * 0.5)""")
def responses_fraction_prefix(spark, sf_dir):
    """First int(n*0.5) prompts per checkpoint (exact rank, no hot-group window)."""
    return normalize.fraction_prefix(fx.responses(spark, sf_dir), 0.5)


@register("json_outputs_kept", with_fixtures(["json_items"]) + """
select checkpoint, count(*) as kept from json_items
where response <> '' and coalesce(json_valid(response), false)
group by checkpoint""")
def json_outputs_kept(spark, sf_dir):
    """Rows whose output is strictly valid JSON, per checkpoint."""
    kept, _ = normalize.split_valid(fx.json_items(spark, sf_dir), "response")
    return kept.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("kept"))


def _status_oracle(short: bool) -> str:
    short_rule = (f"when length({d_trim('r.response')}) < 5 then 'no_output' " if short else "")
    return with_fixtures(["responses"]) + f"""
select checkpoint, response_status, count(*) as n,
       round(count(*) / sum(count(*)) over (partition by checkpoint), 6) as share
from (select v.checkpoint,
             case when r.response is null then 'missing'
                  when r.response = '[no output]' then 'no_output'
                  when starts_with(r.response, '[error:') then 'error'
                  {short_rule}else 'ok' end as response_status
      from instruct i cross join (values ('cp0'), ('cp1'), ('cp2')) v(checkpoint)
      left join responses r on r.prompt_id = i.prompt_id and r.checkpoint = v.checkpoint) s
group by checkpoint, response_status"""


def _status(spark, sf_dir, short_min):
    inst = fx.instruct(spark, sf_dir)
    grid = inst.select("prompt_id", F.explode(F.array(*[F.lit(c) for c in align.CHECKPOINTS]))
                       .alias("checkpoint"))
    resp = fx.responses(spark, sf_dir, inst)
    full = grid.join(resp.select("prompt_id", "checkpoint", "response"),
                     ["prompt_id", "checkpoint"], "left")
    st = normalize.response_status(full, short_min=short_min)
    from ..operators.reports import status_rates
    return status_rates(st)


@register("response_status_rates", _status_oracle(False))
def response_status_rates(spark, sf_dir):
    """B7 + E1 + I11: ok/no_output/error/missing share per checkpoint."""
    return _status(spark, sf_dir, None)


@register("response_status_short", _status_oracle(True))
def response_status_short(spark, sf_dir):
    """As response_status_rates with replies under 5 chars counted as no output."""
    return _status(spark, sf_dir, 5)


@register("responses_truncated", with_fixtures(["responses"]) + """
select prompt_id, checkpoint, substr(response, 1, 200) as response_200 from responses""")
def responses_truncated(spark, sf_dir):
    """First 200 characters of each response."""
    r = fx.responses(spark, sf_dir)
    return r.select("prompt_id", "checkpoint", truncate("response", 200).alias("response_200"))


def _d_body(i: str, x: str) -> str:
    return (f"concat({sq(R.TEMPLATE_HEADER)}, {NL}, {NL}, {sq(R.SECTION_INSTRUCTION)}, {NL}, "
            f"coalesce({i}, ''), {NL}, {NL}, {sq(R.SECTION_INPUT)}, {NL}, "
            f"{d_trim(f'coalesce({x}, {EMPTY})')}, {NL}, {NL}, "
            f"{sq(R.SECTION_RESPONSE)}, {NL})")


@register("prompt_echo_removed", with_fixtures(["responses"]) + f"""
select r.prompt_id, r.checkpoint,
       {d_trim("replace(concat(" + _d_body('i.instruction', 'i.input') + ", r.response), "
               + _d_body('i.instruction', 'i.input') + ", '')")} as response
from responses r join instruct i using (prompt_id)""")
def prompt_echo_removed(spark, sf_dir):
    """Generator output = prompt + reply; every prompt occurrence removed, stripped."""
    inst = fx.instruct(spark, sf_dir)
    r = fx.responses(spark, sf_dir, inst).join(inst.select("prompt_id", "instruction", "input"),
                                                "prompt_id")
    full = r.withColumn("full", F.concat(R.inference_prompt("instruction", "input"),
                                         F.col("response")))
    full = full.withColumn("prompt", R.inference_prompt("instruction", "input"))
    out = normalize.remove_prompt_echo(full, "full", "prompt", "response")
    return out.select("prompt_id", "checkpoint", "response")


# ------------------------------------------------------------------ C
@register("prompts_rendered", with_fixtures(["instruct"]) + f"""
select prompt_id,
       concat({_d_body('instruction', 'input')}, coalesce(output, '')) as train_text,
       {_d_body('instruction', 'input')} as infer_text,
       concat('User: ', instruction, {NL}, {NL}, 'Assistant: ', output) as dialogue_text,
       concat('Instruction: ', instruction, {NL}, 'Input: ', input, {NL}, {NL}, 'Output:')
         as plain_text,
       case when coalesce(input, '') <> '' then concat(instruction, {NL}, {NL}, 'Input: ', input)
            else instruction end as teacher_text
from instruct""")
def prompts_rendered(spark, sf_dir):
    """Training, inference, dialogue, plain and teacher renderings."""
    r = render.render_prompts(fx.instruct(spark, sf_dir))
    return r.select("prompt_id", "train_text", "infer_text", "dialogue_text", "plain_text",
                    "teacher_text")


@register("template_violations", with_fixtures(["instruct"]) + f"""
select template, count(*) as n,
       cast(sum(case when contains(t, 'Instruction:') and contains(t, 'Input:')
                          and contains(t, 'Response:') then 0 else 1 end) as bigint) as violations
from (select 'train' as template, concat({_d_body('instruction', 'input')}, output) as t
      from instruct
      union all select 'dialogue', concat('User: ', instruction, {NL}, {NL}, 'Assistant: ', output)
      from instruct
      union all select 'plain', concat('Instruction: ', instruction, {NL}, 'Input: ', input, {NL},
                                       {NL}, 'Output:') from instruct) u
group by template""")
def template_violations(spark, sf_dir):
    """Rendered prompts missing a required section marker, per template."""
    r = render.render_prompts(fx.instruct(spark, sf_dir))
    u = r.select(F.explode(F.array(
        F.struct(F.lit("train").alias("template"), F.col("train_text").alias("t")),
        F.struct(F.lit("dialogue").alias("template"), F.col("dialogue_text").alias("t")),
        F.struct(F.lit("plain").alias("template"), F.col("plain_text").alias("t")))).alias("x"))
    return (u.select("x.template", R.template_ok("x.t").alias("ok"))
             .groupBy("template").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum((~F.col("ok")).cast("bigint")).alias("violations")))


@register("chat_rendered", """
select conv_id, concat(string_agg(piece, '' order by turn), '<|endoftext|>') as chat_text
from (select conv_id, turn,
             case when role = 'system' and coalesce(text, '') <> ''
                    then concat('<|system|>', chr(10), text, '<|end|>', chr(10))
                  when role = 'user' then concat('<|user|>', chr(10), coalesce(text, ''), '<|end|>', chr(10))
                  when role = 'assistant'
                    then concat('<|assistant|>', chr(10), coalesce(text, ''), '<|end|>', chr(10))
             end as piece
      from conversations) m
where piece is not null
group by conv_id""")
def chat_rendered(spark, sf_dir):
    """Conversations rendered with the chat template, EOS-terminated, one row each."""
    return render.chat_render(table(spark, sf_dir, "conversations"))


@register("judge_prompts", with_fixtures(["responses", "comparisons"]) + f"""
select c.comparison, a.prompt_id,
       concat({sq(R.JUDGE_INTRO)}, {NL}, {NL}, '### INSTRUCTION:', {NL}, i.instruction, {NL}, {NL},
              '### RESPONSE A:', {NL}, a.response, {NL}, {NL}, '### RESPONSE B:', {NL}, b.response,
              {NL}, {NL}, {sq(R.JUDGE_END)}) as judge_text,
       concat('Instruction: ', i.instruction, {NL}, {NL}, 'Response A: ', a.response, {NL}, {NL},
              'Response B: ', b.response) as judge_text_short
from responses a join comparisons c on a.checkpoint = c.challenger
join responses b on b.prompt_id = a.prompt_id and b.checkpoint = c.opponent
join instruct i on i.prompt_id = a.prompt_id""")
def judge_prompts(spark, sf_dir):
    """E8 + C8: pairwise judge prompts (long and short forms) per comparison."""
    inst = fx.instruct(spark, sf_dir)
    pairs = align.comparison_pairs(fx.responses(spark, sf_dir, inst), align.comparison_table(spark))
    p = pairs.join(inst.select("prompt_id", "instruction"), "prompt_id")
    return p.select("comparison", "prompt_id",
                    R.judge_prompt("instruction", "response_a", "response_b").alias("judge_text"),
                    R.judge_prompt_short("instruction", "response_a", "response_b")
                    .alias("judge_text_short"))


# Fixed values (our own): prompt templates per event type, two variants each.
EVENT_TEMPLATES = (
    ("click", "Return the click by user {user_id} as JSON with k={k}.",
              "Encode this click event (user {user_id}, k {k}) as a JSON object."),
    ("view", "Return the view by user {user_id} as JSON with k={k}.",
             "Encode this view event (user {user_id}, k {k}) as a JSON object."),
    ("purchase", "Return the purchase by user {user_id} as JSON with k={k}.",
                 "Encode this purchase event (user {user_id}, k {k}) as a JSON object."),
    ("error", "Return the error seen by user {user_id} as JSON with k={k}.",
              "Encode this error event (user {user_id}, k {k}) as a JSON object."),
    ("signup", "Return the signup of user {user_id} as JSON with k={k}.",
               "Encode this signup event (user {user_id}, k {k}) as a JSON object."),
)


@register("slot_filled_prompts", f"""
with t as (select * from (values {", ".join(f"({sq(a)}, [{sq(b)}, {sq(c)}])" for a, b, c in EVENT_TEMPLATES)}) v(task_type, variants))
select e.event_id,
       replace(replace(t.variants[{d_hash_key('42', 'e.event_id')} % 2 + 1], '{{user_id}}',
               cast(e.user_id as varchar)), '{{k}}', regexp_extract(e.props, '([0-9]+)', 1)) as prompt
from events e join t on t.task_type = e.event_type""")
def slot_filled_prompts(spark, sf_dir):
    """C10 + D6: per event, a template variant of its type chosen by hash, slots filled."""
    tpl = spark.createDataFrame([(a, [b, c]) for a, b, c in EVENT_TEMPLATES],
                                "task_type string, variants array<string>")
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("task_type"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    out = render.slot_fill(ev, tpl, slots=("user_id", "k"),
                           choice_key=seeded_order_key("42", "event_id"))
    return out.select("event_id", "prompt")


# ------------------------------------------------------------------ C11, C13, C15
@register("quota_per_task_type", with_fixtures(["json_items"]) + f"""
select prompt_id, task_type from json_items where checkpoint = 'cp0'
qualify row_number() over (partition by task_type
                           order by {H("concat_ws('|', '42', cast(prompt_id as varchar))")}, prompt_id) <= 20""")
def quota_per_task_type(spark, sf_dir):
    """C11: 20 prompts per task type in seeded hash order."""
    items = fx.json_items(spark, sf_dir).where(F.col("checkpoint") == "cp0")
    return render.per_type_quota(items, 20).select("prompt_id", "task_type")


def _d_canon(x: str) -> str:
    """Key-sorted minified JSON of a flat object (DuckDB oracle of to_json(variant))."""
    return (f"case when json_type({x}) = 'OBJECT' then concat('{{', array_to_string("
            f"list_transform(list_sort(json_keys({x})), lambda kk: concat('\"', kk, '\":', "
            f"json_extract({x}, '$.\"' || kk || '\"')::varchar)), ','), '}}') "
            f"else json({x})::varchar end")


@register("canonical_outputs", with_fixtures(["json_items"]) + f"""
select prompt_id, checkpoint,
       coalesce({_d_canon("case when response <> '' and json_valid(response) then response end")},
                response) as output
from json_items""")
def canonical_outputs(spark, sf_dir):
    """Outputs re-serialised in canonical (key-sorted) JSON when they parse."""
    items = fx.json_items(spark, sf_dir)
    return render.canonical_output(items, "response", "output").select("prompt_id", "checkpoint",
                                                                        "output")


# Fixed values (our own): keyword -> entity dictionary, in priority order.
KEYWORDS = (("Paris", "location"), ("Berlin", "location"), ("Madrid", "location"),
            ("the", "english_marker"), ("der", "german_marker"), ("les", "french_marker"),
            ("los", "spanish_marker"), ("ment", "suffix"))


@register("keyword_entities", f"""
with d as (select * from (values {", ".join(f"({sq(k)}, {i}, {sq(v)})" for i, (k, v) in enumerate(KEYWORDS))}) v(keyword, priority, entity))
select doc.doc_id, h.entity
from documents doc left join (
  select x.doc_id, arg_min(d.entity, d.priority) as entity
  from documents x join d on contains(x.text, d.keyword) group by x.doc_id) h
on h.doc_id = doc.doc_id""")
def keyword_entities(spark, sf_dir):
    """First dictionary keyword contained in each document (theta join)."""
    d = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(KEYWORDS)],
                              "keyword string, priority int, entity string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return render.keyword_lookup(docs, d).select("doc_id", "entity")


# ------------------------------------------------------------------ D
@register("shuffle_positions", with_fixtures(["instruct"]) + f"""
select prompt_id, row_number() over (order by {d_hash_key('42', 'prompt_id')}, prompt_id) as pos
from instruct""")
def shuffle_positions(spark, sf_dir):
    """Seeded permutation positions (exact, range-partitioned)."""
    return sampling.seeded_shuffle(fx.instruct(spark, sf_dir)).select("prompt_id", "pos")


@register("holdout_split", with_fixtures(["instruct"]) + f"""
select prompt_id, case when row_number() over (order by {d_hash_key('42', 'prompt_id')}, prompt_id)
                            <= 50 then 'eval' else 'train' end as split
from instruct""")
def holdout_split(spark, sf_dir):
    """Exactly 50 prompts to eval in seeded hash order, the rest train."""
    return sampling.holdout_split(fx.instruct(spark, sf_dir), 50).select("prompt_id", "split")


@register("stride_split", with_fixtures(["instruct"]) + f"""
select prompt_id, case when (row_number() over (order by {d_hash_key('42', 'prompt_id')}, prompt_id) - 1)
                            % 2 = 0 then 'eval' else 'train' end as split
from instruct""")
def stride_split(spark, sf_dir):
    """D1 + D3: every second row of the seeded order goes to eval."""
    pos = sampling.seeded_shuffle(fx.instruct(spark, sf_dir))
    return sampling.stride_split(pos).select("prompt_id", "split")


@register("fraction_sample", with_fixtures(["responses"]) + f"""
select suite, prompt_id, checkpoint, response from responses
qualify row_number() over (partition by checkpoint
                           order by {d_hash_key('42', 'prompt_id', 'checkpoint')}, prompt_id)
        <= greatest(1, floor(count(*) over (partition by checkpoint) * 0.1))""")
def fraction_sample(spark, sf_dir):
    """max(1, int(n*0.1)) responses per checkpoint without replacement."""
    return sampling.fraction_sample(fx.responses(spark, sf_dir), 0.1,
                                    id_cols=("prompt_id", "checkpoint"), by=("checkpoint",))


@register("fixed_sample", with_fixtures(["responses"]) + f"""
select suite, prompt_id, checkpoint, response from responses
qualify row_number() over (partition by checkpoint
                           order by {d_hash_key('42', 'prompt_id', 'checkpoint')}, prompt_id) <= 25""")
def fixed_sample(spark, sf_dir):
    """25 responses per checkpoint in seeded hash order."""
    return sampling.fixed_sample(fx.responses(spark, sf_dir), 25,
                                 id_cols=("prompt_id", "checkpoint"), by=("checkpoint",))


@register("pair_order_randomized", with_fixtures(["responses", "comparisons"]) + f"""
select comparison, prompt_id, swap,
       case when swap = 1 then response_b else response_a end as shown_a,
       case when swap = 1 then response_a else response_b end as shown_b
from (select c.comparison, a.prompt_id, a.response as response_a, b.response as response_b,
             cast({d_hash_key('swap', 'a.prompt_id', 'c.comparison')} % 2 as int) as swap
      from responses a join comparisons c on a.checkpoint = c.challenger
      join responses b on b.prompt_id = a.prompt_id and b.checkpoint = c.opponent) x""")
def pair_order_randomized(spark, sf_dir):
    """E8 + D7: comparison pairs with a reproducible A/B swap."""
    pairs = align.comparison_pairs(fx.responses(spark, sf_dir), align.comparison_table(spark))
    p = pairs.withColumn("swap", sampling.swap_flag("prompt_id", "comparison"))
    sw = F.col("swap") == 1
    return p.select("comparison", "prompt_id", "swap",
                    F.when(sw, F.col("response_b")).otherwise(F.col("response_a")).alias("shown_a"),
                    F.when(sw, F.col("response_a")).otherwise(F.col("response_b")).alias("shown_b"))


def _d_text_key(a: str, b: str) -> str:
    def norm(c):
        return d_trim(f"regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g')")
    return f"md5(concat_ws(chr(1), {norm(a)}, {norm(b)}))"


D_AUDIT = """audits as (
  select 'stride_full' as audit, key, key in (select key from keyed) as in_train from keyed where (pos - 1) % 2 = 0
  union all
  select 'stride_corrected', key, key in (select key from keyed where (pos - 1) % 2 = 1) from keyed where (pos - 1) % 2 = 0
  union all
  select 'benchmark_lines', key, key in (select key from doc_lines) from bench_lines)"""


@register("contamination_audit", with_fixtures(["instruct"], f"""keyed as (
  select {_d_text_key('instruction', 'input')} as key, row_number() over (order by {d_hash_key('42', 'prompt_id')}, prompt_id) as pos
  from instruct),
doc_lines as (select distinct {_d_text_key('line', "''")} as key from (select unnest(string_split(text, {NL})) as line from documents) a),
bench_lines as (select {_d_text_key('line', "''")} as key from (select unnest(string_split(text, {NL})) as line from benchmark) b),
""" + D_AUDIT) + """
select audit, count(*) as eval_rows, cast(count(*) filter (where in_train) as bigint) as in_train,
       cast(count(*) filter (where not in_train) as bigint) as not_in_train
from audits group by audit""")
def contamination_audit(spark, sf_dir):
    """Evaluation rows that also occur in training data, for three splits.

    ``stride_full``: the whole set is training data and every second row also
    evaluation, as the reference writes them; ``stride_corrected``: the other
    rows are training data; ``benchmark_lines``: lines of the benchmark among
    the lines of the documents.
    """
    inst = sampling.stride_split(sampling.seeded_shuffle(fx.instruct(spark, sf_dir)))
    ev, train = inst.where(F.col("split") == "eval"), inst.where(F.col("split") == "train")

    def lines(name):
        return table(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("instruction"),
                                                 F.lit("").alias("input"))
    audits = (("stride_full", ev, inst), ("stride_corrected", ev, train),
              ("benchmark_lines", lines("benchmark"), lines("documents")))
    parts = [sampling.contamination(e, t).select(F.lit(n).alias("audit"), "in_train") for n, e, t in audits]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("audit").agg(
        F.count(F.lit(1)).alias("eval_rows"), F.count_if("in_train").alias("in_train"),
        F.count_if(~F.col("in_train")).alias("not_in_train"))


@register("duplicate_documents", """
select md5(text) as text_hash, count(*) as copies from documents group by text having count(*) > 1""")
def duplicate_documents(spark, sf_dir):
    """Groups of identical document texts with their copy count."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_hash"))
    return sampling.duplicate_groups(d, ("text_hash",))


# ------------------------------------------------------------------ E
@register("eval_with_outputs", with_fixtures(["responses"]) + """
select i.prompt_id, c.checkpoint, i.instruction, coalesce(r.response, '') as response
from instruct i cross join (values ('cp0'), ('cp1'), ('cp2')) c(checkpoint)
left join responses r on r.prompt_id = i.prompt_id and r.checkpoint = c.checkpoint""")
def eval_with_outputs(spark, sf_dir):
    """Eval rows aligned by id with every checkpoint's outputs, '' when absent."""
    inst = fx.instruct(spark, sf_dir)
    e = inst.select("prompt_id", F.explode(F.array(*map(F.lit, align.CHECKPOINTS))).alias("checkpoint"), "instruction")
    return align.eval_with_outputs(e, fx.responses(spark, sf_dir, inst), keys=("prompt_id", "checkpoint"))


@register("pair_zip", with_fixtures(["responses"]) + """
select a.prompt_id, a.response as response_a, b.response as response_b
from responses a join responses b on a.prompt_id = b.prompt_id
where a.checkpoint = 'cp1' and b.checkpoint = 'cp2'""")
def pair_zip(spark, sf_dir):
    """cp1 and cp2 responses paired by prompt id (inner join)."""
    return align.pair_zip(fx.responses(spark, sf_dir), "cp1", "cp2")


@register("responses_wide", with_fixtures(["responses"]) + """
select suite, prompt_id,
       max(response) filter (where checkpoint = 'cp0') as cp0,
       max(response) filter (where checkpoint = 'cp1') as cp1,
       max(response) filter (where checkpoint = 'cp2') as cp2
from responses group by suite, prompt_id""")
def responses_wide(spark, sf_dir):
    """E5: one column per checkpoint."""
    return align.to_wide(fx.responses(spark, sf_dir))


@register("responses_roundtrip", with_fixtures(["responses"]) + """
select suite, prompt_id, checkpoint, response from responses""")
def responses_roundtrip(spark, sf_dir):
    """E5 then E6: pivot followed by unpivot gives back the long table."""
    return align.to_long(align.to_wide(fx.responses(spark, sf_dir))) \
                .select("suite", "prompt_id", "checkpoint", "response")


@register("phase_fallback", with_fixtures(["responses"]) + """
select prompt_id, coalesce(max(response) filter (where checkpoint = 'cp2'),
                           max(response) filter (where checkpoint = 'cp1')) as response
from responses group by prompt_id""")
def phase_fallback(spark, sf_dir):
    """Phase-2 response, else phase-1."""
    w = align.to_wide(fx.responses(spark, sf_dir))
    return align.phase_fallback(w).select("prompt_id", "response")


@register("suites_concat", with_fixtures(["responses", "json_items"]) + """
select suite, checkpoint, count(*) as n
from (select suite, checkpoint from responses
      union all select 'json' as suite, checkpoint from json_items) u
group by suite, checkpoint""")
def suites_concat(spark, sf_dir):
    """Open-ended and JSON suites concatenated; rows per suite and checkpoint."""
    o = fx.responses(spark, sf_dir).select("suite", "prompt_id", "checkpoint", "response")
    j = fx.json_items(spark, sf_dir).select(F.lit(fx.JSON_SUITE).alias("suite"), "prompt_id",
                                            "checkpoint", "response")
    return align.concat_suites(o, j).groupBy("suite", "checkpoint").agg(
        F.count(F.lit(1)).alias("n"))


@register("message_lists", with_fixtures(["instruct"]) + f"""
select prompt_id,
       to_json([{{'role': 'system', 'content': input}},
                {{'role': 'user', 'content': case when coalesce(input, '') <> ''
                   then concat(instruction, {NL}, {NL}, 'Input: ', input) else instruction end}}])::varchar
         as messages
from instruct""")
def message_lists(spark, sf_dir):
    """C5 + C7: [system, user] chat message list per prompt, serialised as JSON."""
    i = fx.instruct(spark, sf_dir)
    m = R.message_list("input", R.teacher_prompt("instruction", "input"))
    return i.select("prompt_id", F.to_json(m).alias("messages"))
