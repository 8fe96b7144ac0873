"""The corpus pipeline: language, near copies, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, mixing, ngram_join, ring_sharding
from ledgerloom.llm.queries import held_out
from ledgerloom.llm.shared import staged

#: A document is rejected if it has no letter, or if no language scores this much.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The network learns from all but the held-out fold."""
    net = language_id.train(language_id.labelled_sample(docs, ~held_out()))
    found = language_id.identify(docs, net)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8."""
    return ngram_join.one_per_component(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return ring_sharding.assign(docs)


STAGES = [
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
    ("shards", shard_stage),
]

#: Neither the network nor the ring can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
