"""Readers for the driver's parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Session option: partitions that every table read through ``table`` gets.
# Unset (the default), the scan's own partitioning stays. A caller whose files
# hold one row group each sets it, whatever the size of the data.
PARTITIONS = "spark.tuneval.read.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df
