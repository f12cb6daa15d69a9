"""Change logs and other views derived from the driver's tables.

A change log has ``key, ts, is_deleted, value`` (null for a tombstone) and, for transactions, ``tx_id, status``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of ``events``: 'error' deletes the user's value, any other event puts one."""
    deleted, tx = F.col("event_type") == "error", F.expr("event_id div 10")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("ts"),
        deleted.alias("is_deleted"),
        F.when(~deleted, F.col("value")).alias("value"),
        tx.alias("tx_id"),
        F.when(tx % 7 == 0, "rollback").when(tx % 11 == 0, "open").otherwise("commit").alias("status"),
    )


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of append-only chunks: ``chunk_id, length, removed``."""
    chunk, flag = F.expr("l_orderkey div 100"), F.col("l_returnflag")
    removed = F.when(chunk % 10 == 0, True).when(chunk % 3 == 0, flag != "A").otherwise(flag == "R")
    return table(spark, sf_dir, "lineitem").select(chunk.alias("chunk_id"), (F.col("l_quantity").cast("bigint") * 80).alias("length"), removed.alias("removed"))


def read_segments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log folder of JSON segments; rows that cannot be parsed are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
