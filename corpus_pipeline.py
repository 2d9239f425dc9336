"""A corpus pipeline of the training-data operators.

``STAGES`` lists (name, function) in order. Each function takes
``(spark, docs, sf_dir)``, works on all documents its predecessor kept and
returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next one's ``docs``. All but the last return the columns of the
documents they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneval.llm import decontaminate, mixing, quality_rules, simhash, token_files
from tuneval.llm.common import configure, read, scratch_path, written
from tuneval.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    configure(spark)
    return quality_rules.keep_quality(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    configure(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    configure(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"), without_id=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, taken or left."""
    configure(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, digested per document (copies have a row each)."""
    configure(spark)
    out = scratch_path(spark, "pipeline-token-files")
    token_files.write_tokens(docs, out, tokenizer("word_bpe_49k.json"))
    return token_files.digests(token_files.read_tokens(spark, out))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("mix_sources", mix),
    ("token_files", tokens),
]

# Trained models, XXH64 and tokenizer merges are beyond SQL: the stages are
# tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
