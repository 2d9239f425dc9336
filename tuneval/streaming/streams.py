"""Streaming versions of the log monitor (L1) and verdict aggregation (L2).

Both read a file source with a declared schema, keep their state in a
checkpoint location under the shared checkpoint folder, and publish the
result of each micro-batch with ``foreachBatch`` as a folder of its own
(``batch_id=N``). Readers take the last complete one (``latest_result``), so
they never see a table between deletion and writing. Executor loss is
recovered by the engine from the state; to resume after a driver restart,
pass the same ``state_path`` and ``out_path`` again. ``available_now=True``
processes what is there and stops (tests, scheduled runs); otherwise
``interval`` sets a trigger.

Contract of the input folders: verdicts come as files that are complete when
they appear; logs may grow in place (``sources.log_tail`` keeps the bytes read
of each). ``poll_training_logs`` scans a folder of logs once, without state.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators import verdicts as V
from ..session import checkpoint_dir, scratch_table
from ..sources import files, log_tail


def _paths(spark: SparkSession, name: str, state_path=None, out_path=None):
    base = checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:8]}"
    return state_path or base + "/state", out_path or base + "/result"


def _run(df: DataFrame, out_path: str, state: str, mode: str, available_now: bool,
         interval: str):
    def publish(batch: DataFrame, batch_id: int):
        # a batch that is run again after a failure replaces its own folder only
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def latest_result(spark: SparkSession, out_path: str) -> DataFrame:
    """The result table of the last published micro-batch.

    A batch folder without rows (an aggregate over nothing) publishes no
    newer state, so the last one with rows counts.
    """
    d = spark.read.parquet(out_path)
    last = d.agg(F.max("batch_id")).first()[0]
    return d.where(F.col("batch_id") == F.lit(last)).drop("batch_id")


def late_rows(query) -> int:
    """Rows that the query's watermark has dropped as too late, over the
    progress reports the engine still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def changed_results(spark: SparkSession, out_path: str, keys) -> DataFrame:
    """The result of a stream that publishes changed rows only: for every key
    the row of the last micro-batch that published it."""
    d = spark.read.parquet(out_path)
    rest = [c for c in d.columns if c not in (*keys, "batch_id")]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return last.select(*keys, "r.*")


def training_log_monitor(spark: SparkSession, log_dir: str, available_now: bool = True,
                         interval: str = "60 seconds", state_path: str | None = None,
                         out_path: str | None = None, range_bytes: int = log_tail.RANGE_BYTES):
    """L1: latest loss and epoch per log file, as the logs grow and new ones appear.

    Every line is read once (``sources.log_tail``); the last values per log are
    state of the query, and a micro-batch publishes the logs it changed. Returns
    ``(query, result_path)``; ``changed_results(spark, result_path, ["log"])``
    holds one row per log.
    """
    state, out = _paths(spark, "training-log", state_path, out_path)
    lines = log_tail.appended_lines(spark, log_dir, range_bytes)
    agg = files.latest_log_values(files.parse_log_lines(lines))
    q = _run(agg, out, state, "update", available_now, interval)
    return q, out


def poll_training_logs(spark: SparkSession, log_dir: str) -> DataFrame:
    """L1 without a stream: one scan of the folder as it is now."""
    return files.latest_log_values(files.parse_log_lines(files.read_training_logs(spark, log_dir)))


KEY = ("comparison", "prompt_id", "swap")
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


NEVER = (1 << 63) - 1      # no arrival known: behind every other
GROUPS = 1 << 12           # keys share a state: a call of the function costs more than a key in it


def _first_replies(replies: DataFrame, seen_for: str) -> DataFrame:
    """The replies whose key the state has not seen; a key leaves the state
    ``seen_for`` after its last delivery. Of a micro-batch's copies the one
    that arrived first counts.

    A state holds the keys of one hash group with the time of their last
    delivery. Keys and times travel as a text and a number, which keep their
    values beside nulls.
    """
    ttl = int(pd.Timedelta(seen_for).total_seconds() * 1000)

    def first(_, parts, state):
        now = state.getCurrentProcessingTimeMs()
        seen = dict(zip(*state.get)) if state.exists else {}
        here = []
        if not state.hasTimedOut:
            d = pd.concat(list(parts), ignore_index=True)
            here = d["key"].unique().tolist()
            d = d[~d["key"].isin(seen.keys())].sort_values("arrived_at", kind="stable").drop_duplicates("key")
            if len(d):
                yield d.drop(columns="group", errors="ignore")
        kept = {k: t for k, t in seen.items() if t + ttl > now} | dict.fromkeys(here, now)
        if not kept:
            state.remove()
            return
        state.update((list(kept), list(kept.values())))
        state.setTimeoutDuration(max(1, min(kept.values()) + ttl - now))

    key = F.struct(*KEY)
    of_key = replies.select(*KEY).schema
    rest = [c for c in replies.columns if c not in (*KEY, "arrived_at")]
    d = replies.select(F.to_json(key).alias("key"), F.coalesce(F.unix_micros("arrived_at"), F.lit(NEVER)).alias("arrived_at"),
                       *rest)
    d = (d.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
         .applyInPandasWithState(first, d.schema, "keys array<string>, times array<long>", "append", "ProcessingTimeTimeout"))
    d = d.withColumns({"key": F.from_json("key", of_key), "arrived_at": F.when(
        F.col("arrived_at") < NEVER, F.timestamp_micros("arrived_at"))})
    return d.select(*[F.col("key")[c].alias(c) if c in KEY else F.col(c) for c in replies.columns])


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the micro-batches before this one published under ``path``."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException:
        return None


def verdict_win_rates(spark: SparkSession, verdict_dir: str, watermark: str = "1 hour",
                      available_now: bool = True, interval: str = "60 seconds",
                      state_path: str | None = None, out_path: str | None = None,
                      files_per_batch: int | None = None, seen_for: str | None = None):
    """L2: running win rates per comparison over arriving judge replies.

    Replies may be delivered more than once: a reply counts once per
    (comparison, prompt_id, swap), a judgement of the swapped order is one of its
    own. Keys are state for ``seen_for`` (twice the watermark if not set, in
    processing time), so the state is bounded by what arrives in that time. A
    reply whose ``arrived_at`` lies more than ``watermark`` behind the greatest
    of the micro-batches before is late: its key may have left the state, so late
    replies, and only these, are looked up among all replies counted so far.

    Every micro-batch writes the replies it counts (``<out>_counted``), its late
    copies (``<out>_late``) and, as result, the comparisons whose counts it
    changed; ``changed_results(spark, out, ["comparison"])`` is the current table.
    A batch that is run again overwrites its own folders and reads those before
    it only, so each reply counts once.
    """
    state, out = _paths(spark, "verdicts", state_path, out_path)
    reader = spark.readStream.schema(S.RAW_VERDICT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    first = _first_replies(reader.json(verdict_dir), seen_for or str(2 * pd.Timedelta(watermark)))
    delay = F.expr(f"interval {watermark}")

    def publish(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        done = _before(s, out, batch_id)
        horizon = done.agg(F.max("max_arrived")).first()[0] if done is not None else None
        here, counted, late = (f"{p}/batch_id={batch_id}" for p in (out, out + "_counted", out + "_late"))
        if horizon is None:
            batch.write.mode("overwrite").parquet(counted)
        else:
            rows = scratch_table(batch, "stream-batch")
            is_late = F.coalesce(F.col("arrived_at") < F.lit(horizon) - delay, F.lit(False))
            old = rows.where(is_late)
            known = _before(s, out + "_counted", batch_id).select(*KEY)
            (rows.where(~is_late).unionByName(old.join(known, list(KEY), "left_anti").select(*rows.columns))
             .write.mode("overwrite").parquet(counted))
            old.join(known, list(KEY), "left_semi").write.mode("overwrite").parquet(late)
        new = s.read.schema(batch.schema).parquet(counted)
        v = V.normalize_verdicts(V.parse_verdicts(new))
        totals = V.win_counts(v).join(new.groupBy("comparison").agg(F.max("arrived_at").alias("max_arrived")), "comparison")
        if done is not None:
            counts = [c for c in totals.columns if c not in ("comparison", "max_arrived")]
            last = done.groupBy("comparison").agg(F.max_by(F.struct(*counts, "max_arrived"), "batch_id").alias("r"))
            totals = (totals.unionByName(last.select("comparison", "r.*").join(totals.select("comparison"), "comparison", "left_semi"))
                      .groupBy("comparison").agg(*[F.sum(c).alias(c) for c in counts], F.max("max_arrived").alias("max_arrived")))
        V.rates_of(totals, keep=("wins_a", "wins_b", "ties", "max_arrived")).write.mode("overwrite").parquet(here)

    w = first.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    # keys time out with the next data: without it the engine would run empty batches for ever
    before = spark.conf.get(NO_DATA_BATCHES, None)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        return w.start(), out
    finally:
        spark.conf.unset(NO_DATA_BATCHES) if before is None else spark.conf.set(NO_DATA_BATCHES, before)
