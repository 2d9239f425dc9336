"""Queries that write a given table in a file format of the surveyed project
and read it back through the library's sources (A3-A6, A8, J9, J15).

Every file holds one bucket of conversations, one event type or one day, so
the number of files grows with the tables and a file stays small.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import jsonfn as J
from ..operators import ablation, jsonq, normalize, render, reports
from ..session import scratch_path
from ..sources import files
from ..sources import fixtures as fx
from ..sources.tables import table
from .catalog import register
from .oracle_fixtures import with_fixtures
from .q_json import items_with_schema

BUCKET = 20     # conversations of a file


def one_file_each(df, key, value, path):
    """Write every row's text as a file of its own, in a folder named by key."""
    (df.select(F.col(key).cast("string").alias("bucket"), value.alias("value"))
       .repartition("bucket").write.partitionBy("bucket").text(path))
    return path


def bucket_of(c="source_file"):
    return F.regexp_extract(c, "bucket=([^/]+)/", 1).alias("bucket")


SPAN = 4096     # turns of a conversation in a file


def _bucket(c="prompt_id"):
    """A file's prompts: those of BUCKET conversations within SPAN turns."""
    return F.concat_ws("-", F.expr(f"{c} div {fx.TURNS * BUCKET}"), F.expr(f"{c} % {fx.TURNS} div {SPAN}"))


D_BUCKET = f"concat(prompt_id // {fx.TURNS * BUCKET}, '-', prompt_id % {fx.TURNS} // {SPAN})"


def write_array_files(rows, names, path):
    """Write rows (bucket, name, pos, value) as JSON files, one per bucket: an
    object of the arrays ``names``, or one array if there is one name, None.

    A file's lines are sorted and streamed out; no array is gathered in a row.
    The brackets come with the file's first line: lines and brackets from two
    sides of a union need not meet in one task, and then not in one file.
    """
    keys = [n or "" for n in names]
    opens = ["[" if n is None else (", " if k else "{") + f'"{n}": [' for k, n in enumerate(names)]
    marks = [(2 * k + 1, ("]" if k else "") + o) for k, o in enumerate(opens)]
    marks.append((2 * len(names) + 1, "]" if names[0] is None else "]}"))
    at = F.array_position(F.array(*map(F.lit, keys)), F.coalesce("name", F.lit(""))).cast("int")
    w = Window.partitionBy("bucket").orderBy("ord", "pos")
    lines = rows.select("bucket", (2 * at).alias("ord"), "pos", "value").select(
        "bucket", "ord", F.row_number().over(w).alias("nth"), F.lag("ord").over(w).alias("before"), "value")

    def part(ord_, value):
        return F.struct(ord_.alias("ord"), value.alias("value"))
    line = part(F.col("ord"), F.concat(F.when(F.col("before") == F.col("ord"), ",").otherwise(""), "value"))
    around = F.array(*[part(F.lit(k), F.lit(v)) for k, v in marks])
    parts = F.when(F.col("nth") == 1, F.concat(F.array(line), around)).otherwise(F.array(line))
    (lines.select("bucket", "nth", F.explode(parts).alias("p")).sortWithinPartitions("bucket", "p.ord", "nth")
     .select("bucket", "p.value").write.partitionBy("bucket").text(path))
    return path


@register("instruct_array_roundtrip", with_fixtures(["instruct"]) + f"""
select bucket, row_number() over (partition by bucket order by prompt_id) - 1 as prompt_id, instruction, input, output
from (select *, {D_BUCKET} as bucket from instruct) x""")
def instruct_array_roundtrip(spark, sf_dir):
    """A1, array form: instruction sets as JSON arrays, read back in byte ranges
    with the position as the prompt's number."""
    rows = fx.instruct(spark, sf_dir).select(
        _bucket().alias("bucket"), F.lit(None).cast("string").alias("name"), F.col("prompt_id").alias("pos"),
        F.to_json(F.struct("instruction", "input", "output")).alias("value"))
    path = write_array_files(rows, [None], scratch_path(spark, "arrays"))
    d = files.read_instruction_array(spark, path, files.S.INSTRUCTION)
    return d.select(bucket_of(), "prompt_id", "instruction", "input", "output")


@register("suite_containers", with_fixtures(["responses"]) + f"""
select bucket, i.suite, pos as prompt_id, r.checkpoint, r.response
from (select prompt_id, bucket, case when input = '' then 'alpaca' else 'json' end as suite,
             row_number() over (partition by bucket, input = '' order by prompt_id) - 1 as pos
      from (select *, {D_BUCKET} as bucket from instruct) x) i join responses r using (prompt_id)""")
def suite_containers(spark, sf_dir):
    """A3: containers of two suites, written one per bucket and read back as long rows."""
    inst = fx.instruct(spark, sf_dir)
    wide = fx.responses(spark, sf_dir, inst).groupBy("prompt_id").pivot(
        "checkpoint", ["cp0", "cp1", "cp2"]).agg(F.max("response"))
    row = F.to_json(F.struct(
        "instruction", "input", F.col("output").alias("expected_output"), F.col("cp0").alias("baseline_response"),
        F.col("cp1").alias("phase1_alpaca_response"), F.col("cp2").alias("phase2_json_response")))
    rows = inst.join(wide, "prompt_id", "left").select(
        _bucket().alias("bucket"), F.when(F.col("input") == "", "alpaca").otherwise("json").alias("name"),
        F.col("prompt_id").alias("pos"), row.alias("value"))
    path = write_array_files(rows, list(files.S.SUITES), scratch_path(spark, "suites"))
    long = files.wide_to_long(files.read_suite_container(spark, path), keys=("source_file", "suite", "prompt_id"))
    return long.select(bucket_of(), "suite", "prompt_id", "checkpoint", "response")


@register("model_containers", with_fixtures(["responses"]) + f"""
select {D_BUCKET} as bucket, checkpoint, prompt_id as prompt_idx, response from responses""")
def model_containers(spark, sf_dir):
    """A4: containers keyed by model, written one per bucket and read back as long rows."""
    models = {"cp0": "baseline", "cp1": "stage1_alpaca", "cp2": "stage2_json"}
    name = F.create_map(*[F.lit(x) for kv in models.items() for x in kv])
    rows = fx.responses(spark, sf_dir).select(
        _bucket().alias("bucket"), F.element_at(name, F.col("checkpoint")).alias("name"), F.col("prompt_id").alias("pos"),
        F.to_json(F.struct(F.col("prompt_id").alias("prompt_idx"), F.lit("").alias("instruction"), "response"))
        .alias("value"))
    path = write_array_files(rows, list(models.values()), scratch_path(spark, "models"))
    return files.read_model_container(spark, path).select(bucket_of(), "checkpoint", "prompt_idx", "response")


def write_runs(spark, sf_dir):
    """One metadata file per day of events: epochs = days since 2024-01-01 + 1,
    training_loss = the day's mean value."""
    day = F.datediff(F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("date")) + 1
    runs = table(spark, sf_dir, "events").groupBy(day.alias("epochs")).agg(
        F.round(F.avg("value"), 6).alias("training_loss"), F.count(F.lit(1)).cast("int").alias("batch_size"))
    meta = F.to_json(F.struct("epochs", F.lit(2e-5).alias("learning_rate"), "batch_size", "training_loss"))
    return one_file_each(runs, "epochs", meta, scratch_path(spark, "runs"))


D_RUNS = """runs as (select cast(datediff('day', date '2024-01-01', ts::date) + 1 as int) as epochs,
                round(avg(value), 6) as training_loss, cast(count(*) as int) as batch_size from events group by 1)"""


@register("run_metadata", f"with {D_RUNS} select cast(epochs as varchar) as bucket, epochs, batch_size, training_loss from runs")
def run_metadata(spark, sf_dir):
    """A5: a folder tree of run metadata files, scanned by one glob."""
    m = files.read_run_metadata(spark, write_runs(spark, sf_dir) + "/*/")
    return m.select(bucket_of(), "epochs", "batch_size", "training_loss")


@register("loss_curve", f"""with {D_RUNS}
select epochs, training_loss, round(training_loss - lag(training_loss) over (order by epochs), 6) as loss_delta,
       (select arg_min(epochs, (training_loss, epochs)) from runs) as best_epochs
from runs""")
def loss_curve(spark, sf_dir):
    """A5 + J15: loss per run, its change from the run before, and the best run."""
    c = ablation.loss_curve(files.read_run_metadata(spark, write_runs(spark, sf_dir) + "/*/"))
    return c.select("epochs", "training_loss", F.round("loss_delta", 6).alias("loss_delta"), "best_epochs")


@register("trainer_states", """
select event_type as bucket, cast(row_number() over (partition by event_type order by d) as int) as step, loss
from (select event_type, ts::date as d, round(avg(value), 6) as loss from events group by all) x""")
def trainer_states(spark, sf_dir):
    """Trainer states, one file per event type, one history entry per day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(
        F.round(F.avg("value"), 6).alias("loss"))
    states = days.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("d", "loss"))).alias("h"))
    history = F.transform("h", lambda x, i: F.struct(
        (i + 1).cast("double").alias("epoch"), F.lit(1.0).alias("grad_norm"), F.lit(2e-5).alias("learning_rate"),
        x["loss"].alias("loss"), (i + 1).cast("int").alias("step")))
    path = one_file_each(states, "event_type", F.to_json(F.struct(history.alias("log_history"))),
                         scratch_path(spark, "states"))
    return files.read_trainer_state(spark, path + "/*/").select(bucket_of(), "step", "loss")


VARIATIONS = 2


@register("template_expansion", with_fixtures(["instruct"]) + f"""
, t as (select conv_id, arg_min(text, turn) as instruction from conversations where role = 'user' group by conv_id),
v as (select *, row_number() over (partition by conv_id order by turn) as k from instruct)
select cast(t.conv_id as varchar) as task_type, v.instruction, v.input
from t join v using (conv_id) where k <= {VARIATIONS}
union all
select cast(conv_id as varchar), instruction, '' from t, range({VARIATIONS}) where conv_id not in (select conv_id from v)""")
def template_expansion(spark, sf_dir):
    """A8 + C12: task templates read from files; per template its first two
    variations, or the template itself twice where it has none."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("instruction"))
    boxes = users.groupBy(F.floor(F.col("conv_id") / BUCKET).alias("b")).agg(F.collect_list(F.struct(
        F.col("conv_id").cast("string").alias("task_type"), "instruction", F.lit("").alias("input"))).alias("ts"))
    path = one_file_each(boxes, "b", F.to_json("ts"), scratch_path(spark, "templates"))
    variations = fx.instruct(spark, sf_dir).select(F.col("conv_id").cast("string").alias("task_type"), "instruction",
                                                   "input", F.col("turn").alias("position"))
    return render.expand_with_fallback(files.read_templates(spark, path), variations, VARIATIONS)


@register("embedded_json", with_fixtures(["json_items"]) + """
select checkpoint, count(x) as found, count(*) filter (where x <> '' and coalesce(json_valid(x), false)) as valid
from (select checkpoint, nullif(regexp_extract(response, '(?s)\\{.*\\}', 0), '') as x from json_items) t
group by checkpoint""")
def embedded_json(spark, sf_dir):
    """Outputs that hold an object by the regex form, and those where it parses."""
    d = fx.json_items(spark, sf_dir).select("checkpoint", J.embedded_regex("response").alias("x"))
    return d.select("checkpoint", "x", J.strict_valid("x").alias("ok")).groupBy("checkpoint").agg(
        F.count("x").alias("found"), F.count_if("ok").alias("valid"))


@register("ablation_log", with_fixtures(["json_items"]) + """
select checkpoint, task_type, count(*) as n from json_items group by checkpoint, task_type""")
def ablation_log(spark, sf_dir):
    """Results appended to a log, a run per checkpoint, every run twice as after
    a retry, and read back."""
    path = scratch_path(spark, "ablation-log")
    counts = fx.json_items(spark, sf_dir).groupBy("checkpoint", "task_type").agg(F.count(F.lit(1)).alias("n"))
    for cp, _ in fx.CHECKPOINT_BIAS * 2:
        ablation.append_results(counts.where(F.col("checkpoint") == cp), path, run_id=cp)
    return ablation.read_results(spark, path).where("timestamp is not null").drop("timestamp", "run_id")


@register("status_guard", with_fixtures(["responses"]) + """
select checkpoint, error_share
from (select checkpoint, round(count(*) filter (where starts_with(response, '[error:')) / count(*), 6) as error_share
      from responses group by checkpoint) x
where error_share > 0.03""")
def status_guard(spark, sf_dir):
    """Checkpoints of which more than 3 % of the responses are errors."""
    s = normalize.response_status(fx.responses(spark, sf_dir))
    return reports.status_guard(reports.status_rates(s), 0.03)


@register("json_schema_errors", with_fixtures(["json_items"]) + """
select checkpoint, error, count(*) as n
from (select checkpoint, unnest(case when not obj then ['Output is not a JSON object'] else
               list_concat(list_transform(list_filter(['event_type', 'k', 'user_id'], lambda f: not list_contains(json_keys(j), f)),
                                          lambda f: 'Missing required field: ' || f),
                           case when json_type(json_extract(j, '$.k')) = 'VARCHAR'
                                then ['Field ''k'' should be number, got str'] else [] end) end) as error
      from (select *, coalesce(json_type(j) = 'OBJECT', false) as obj
            from (select checkpoint, case when response <> '' and json_valid(response) then response end as j from json_items) a) b) c
group by checkpoint, error""")
def json_schema_errors(spark, sf_dir):
    """F8 + F9: schema violations in words, per checkpoint."""
    s = jsonq.schema_check(items_with_schema(spark, sf_dir))
    # the outer form: a plain explode infers a filter that would repeat the parse
    e = s.select("checkpoint", F.explode_outer("errors").alias("error")).groupBy("checkpoint", "error").agg(
        F.count(F.lit(1)).alias("n"))
    return e.where("error is not null")
