"""Queries for sources, sinks and streams (A, L)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..session import scratch_path
from ..sources import files
from ..sources import fixtures as fx
from ..sources.tables import table
from ..streaming import streams
from .catalog import register
from .oracle_fixtures import with_fixtures
from .q_judge import D_VERDICTS, D_WINS

ID_RECORD = T.StructType([T.StructField("prompt_id", T.LongType())] + list(
    files.S.INSTRUCTION.fields))


@register("instruct_jsonl_roundtrip", with_fixtures(["instruct"]) + """
select prompt_id, instruction, input, output from instruct""")
def instruct_jsonl_roundtrip(spark, sf_dir):
    """A2 + A1: instruction set written as JSON lines, read back with a declared schema."""
    path = scratch_path(spark, "instruct")
    files.write_table(fx.instruct(spark, sf_dir).select("prompt_id", "instruction", "input",
                                                        "output"), path, fmt="json")
    return files.read_instruction_lines(spark, path, ID_RECORD)


def write_logs(spark, sf_dir) -> str:
    """Stand-in training logs: one log file per event type and day, one line
    per event in time order. Every third line tells the loss only and every
    third the epoch only (microseconds since 2024-01-01)."""
    e = table(spark, sf_dir, "events")
    # ts is TIMESTAMP_NTZ; the session time zone is UTC
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200 * 1000000)).cast("bigint")
    kind = F.col("event_id") % 3
    parts = F.concat_ws(", ", F.when(kind != 1, F.format_string("'loss': '%s'", F.col("value").cast("string"))),
                        F.lit("'learning_rate': '2e-05'"),
                        F.when(kind != 2, F.format_string("'epoch': '%d'", step)))
    lines = e.select("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"),
                     F.concat(F.lit("{"), parts, F.lit("}")).alias("value"), step.alias("_s"), "event_id")
    path = scratch_path(spark, "logs")
    (lines.repartition("event_type", "day").sortWithinPartitions("event_type", "day", "_s", "event_id")
          .drop("_s", "event_id").write.partitionBy("event_type", "day").text(path))
    return path


D_LOGS = """
select 'event_type=' || event_type || '/day=' || strftime(ts, '%Y-%m-%d') as log,
       arg_max(value, (ts, event_id)) filter (where event_id % 3 <> 1) as loss,
       max(epoch_us(ts) - 1704067200000000) filter (where event_id % 3 <> 2)::double as epoch, count(*) as lines
from events group by 1"""


def _run_name(d):
    """The part of a log's path that does not change from run to run."""
    return d.withColumn("log", F.regexp_extract("log", "(event_type=[^/]+/day=[^/]+)/[^/]+$", 1))


@register("training_log_last", D_LOGS)
def training_log_last(spark, sf_dir):
    """Last loss and last epoch of every training log file (numbered lines + max_by)."""
    return _run_name(streams.poll_training_logs(spark, write_logs(spark, sf_dir)))


@register("training_log_stream", D_LOGS)
def training_log_stream(spark, sf_dir):
    """L1: the log monitor as a stream over growing logs (AvailableNow), changed logs
    published by foreachBatch."""
    q, out = streams.training_log_monitor(spark, write_logs(spark, sf_dir), available_now=True)
    q.awaitTermination()
    return _run_name(streams.changed_results(spark, out, ["log"]))


@register("verdict_stream_win_rates", with_fixtures(["verdicts"], D_VERDICTS) + D_WINS.format(src="vn"))
def verdict_stream_win_rates(spark, sf_dir):
    """L2: judge replies delivered twice to a stream; duplicates dropped within
    the watermark; running win rates equal the batch result."""
    v = fx.verdicts(spark, sf_dir).withColumn(
        "arrived_at", F.timestamp_seconds(F.lit(1704067200) + F.col("prompt_id") % 86400))
    path = scratch_path(spark, "verdict-stream")
    for part in ("delivery-1", "delivery-2"):
        v.write.json(f"{path}/{part}")
    q, out = streams.verdict_win_rates(spark, f"{path}/*")
    q.awaitTermination()
    return streams.changed_results(spark, out, ["comparison"]).drop("wins_a", "wins_b", "ties", "max_arrived")
