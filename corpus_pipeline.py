"""The corpus pipeline: filter by quality, drop near copies, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, extra columns too.

In every stage a null text counts as empty, an empty table gives an empty table, and texts are read whole whatever their length. Rows
without a doc_id are scored, mixed and sharded like others; near_dedup and decontamination let them pass. Rows that repeat a doc_id
are kept or dropped together by quality (if their texts are equal) and decontamination; near_dedup keeps one of them. Ties go to the
smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, extendible_shards, near_copies, quality_ranker, temperature_mix
from tidemark.llm.common import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts. Fitted on all pairs of all labelled documents."""
    model = quality_ranker.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality_ranker.score(docs, model).where("quality_score >= 0.5").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group that five-word shingles link at a similarity of 0.8 or more."""
    return near_copies.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them."""
    return temperature_mix.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that holds them."""
    return extendible_shards.assign_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The ranker, the fingerprints and the walks are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
