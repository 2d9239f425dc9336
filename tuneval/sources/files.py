"""File sources and sinks (A1-A10).

JSON *arrays* and objects of arrays carry identity by position: the position
becomes the explicit ``prompt_id``. They are read in byte ranges
(``json_ranges``), so a large file is many tasks, and a truncated, malformed or
empty one is an error that names file and byte. JSON lines and Parquet are
splittable and read with declared schemas; lines and small JSON files that do
not parse are errors too (``FAILFAST``). Logs are read line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from . import json_ranges

# Checkpoint names used across the reference's files -> ours.
CHECKPOINT_ALIASES = {
    "baseline": "cp0", "checkpoint_0_baseline": "cp0",
    "phase1_alpaca": "cp1", "checkpoint_1_alpaca": "cp1", "stage1_alpaca": "cp1",
    "phase2_json": "cp2", "checkpoint_2_json": "cp2", "stage2_json": "cp2",
}


def checkpoint_name(c) -> F.Column:
    """Normalise a checkpoint/model name to cp0/cp1/cp2 (others unchanged)."""
    m = F.create_map(*[F.lit(x) for kv in CHECKPOINT_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def read_instruction_array(spark: SparkSession, path: str, schema=S.EVAL_RECORD) -> DataFrame:
    """A1 (JSON array form): one row per element, ``prompt_id`` = position."""
    d = json_ranges.read_array(spark, path, schema)
    return d.select("source_file", F.col("position").alias("prompt_id"), "r.*")


def read_instruction_lines(spark: SparkSession, path: str, schema=S.EVAL_RECORD) -> DataFrame:
    """A1 / A9 (JSON lines form, splittable), declared schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=()) -> None:
    """A2 / A10: write a table (parquet default, JSON lines with ``fmt='json'``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def read_suite_container(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``{"alpaca": [...], "json": [...]}`` -> rows with ``suite`` and position.

    Arrays under other names are not suites and left out.
    """
    d = json_ranges.read_container(spark, path, S.WIDE_RESPONSE)
    return (d.where(F.col("key").isin(*S.SUITES))
            .select("source_file", F.col("key").alias("suite"), F.col("position").alias("prompt_id"), "r.*"))


def wide_to_long(wide: DataFrame, keys=("suite", "prompt_id")) -> DataFrame:
    """M7 -> canonical long ``(suite, prompt_id, checkpoint, response)``."""
    cols = {"baseline_response": "cp0", "phase1_alpaca_response": "cp1",
            "phase2_json_response": "cp2"}
    present = [c for c in cols if c in wide.columns]
    long = wide.unpivot(list(keys), present, "checkpoint", "response")
    return long.withColumn("checkpoint", F.element_at(
        F.create_map(*[F.lit(x) for kv in cols.items() for x in kv]), F.col("checkpoint"))) \
        .where(F.col("response").isNotNull())


def read_model_container(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``{model: [{prompt_idx, instruction, response}]}`` -> long rows.

    The sink side writes these long rows (``write_table``), not one object
    per model, which would gather a checkpoint's responses into one row.
    """
    r = json_ranges.read_container(spark, path, S.MODEL_RESPONSE).select(
        "source_file", F.col("key").alias("model"), "r.*")
    return r.withColumn("checkpoint", checkpoint_name(F.col("model")))


def _json_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """Small JSON files, a value each; one that is empty or does not parse is an error."""
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    d = d.withColumn("source_file", F.col("_metadata.file_path"))
    json_ranges.no_empty_file(d.inputFiles(), d.select("source_file").distinct().collect())
    return d


def read_run_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """A5: per-run metadata JSON files (glob) with their file path."""
    return _json_files(spark, glob, S.RUN_METADATA)


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per logged step of ``log_history``."""
    st = _json_files(spark, path, S.TRAINER_STATE)
    return st.select("source_file", F.explode("log_history").alias("h")).select("source_file", "h.*")


# How a training log line spells the loss and epoch.
LOSS_PATTERN = r"'loss': '([^']*)'"
EPOCH_PATTERN = r"'epoch': '([^']*)'"


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """A7 parsing step: loss and epoch out of each line (NULL when absent)."""
    loss = F.nullif(F.regexp_extract(value, LOSS_PATTERN, 1), F.lit(""))
    ep = F.nullif(F.regexp_extract(value, EPOCH_PATTERN, 1), F.lit(""))
    return lines.withColumn("loss", loss.try_cast("double")) \
                .withColumn("epoch", ep.try_cast("double"))


def latest_log_values(parsed: DataFrame, by=("log",)) -> DataFrame:
    """Per log the last loss and the last epoch that any line tells, found
    independently of each other, and the number of lines that tell either."""
    loss, epoch = F.col("loss"), F.col("epoch")
    return (parsed.where(loss.isNotNull() | epoch.isNotNull()).groupBy(*by).agg(
        F.max_by("loss", F.when(loss.isNotNull(), F.col("line"))).alias("loss"),
        F.max_by("epoch", F.when(epoch.isNotNull(), F.col("line"))).alias("epoch"),
        F.count(F.lit(1)).alias("lines")))


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log, line, value) of every log file under ``path``.

    Every file is a log of its own, also where many lie in one folder. A log of
    any size is read in byte ranges: ``line`` orders its lines by the range they
    stand in and their place there; it is no running number.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("log"), place.alias("line"), "value")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Task templates (a JSON array)."""
    return read_instruction_array(spark, path, S.TEMPLATE).drop("source_file", "prompt_id")
