"""Streaming ingest into a log folder, and stateful broadcast progress.

Ingest is idempotent: a micro-batch is written under its batch id and readers take each (key, ts) once, so a
batch that is delivered again changes nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import live


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ingest(stream: DataFrame, log_path: str, checkpoint: str, repeat: bool = False):
    """Append a stream of log rows to ``log_path``, a folder for each batch; ``repeat`` delivers each batch twice."""

    def write(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates(["key", "ts"]).write.mode("overwrite").parquet(f"{log_path}/batch={n}")
        if repeat:
            batch.dropDuplicates(["key", "ts"]).write.mode("overwrite").parquet(f"{log_path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream ``events`` as a change log into a folder, and read the latest values back."""
    path = folder(spark, "ingest")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    deleted = F.col("event_type") == "error"
    log = rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), deleted.alias("is_deleted"), F.when(~deleted, F.col("value")).alias("value"))
    ingest(log, f"{path}/log", f"{path}/checkpoint", repeat=True).awaitTermination()
    return live(spark.read.parquet(f"{path}/log").select("key", "ts", "is_deleted", "value"))


def quorum_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of broadcasts over streamed peer answers: the last counts of each task."""
    path = folder(spark, "quorum")
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parquet*")
    peers = rows.select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("ok"))
    # The running counts are streaming state; a task is told of once it has a success.
    out = peers.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("success")).where("success > 0")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("task_id bigint, total bigint, success bigint").parquet(f"{path}/out/*")
    return got.groupBy("task_id").agg(F.max("total").alias("total"), F.max("success").alias("success"))
