"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: batches of long documents stay small.
ARROW_ROWS = 512


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``.

    The folder must be visible to the driver and all executors. Only in local mode, with the setting
    unset, is a temporary folder of the machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames from ``materialize`` that nothing reads any more."""
    for f in frames:
        spark = f.sparkSession
        for folder in {x.rpartition("/")[0] for x in f.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class HashMemo(dict):
    """bytes -> 64-bit XXH64, remembering up to ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 250_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


def chunks(batches: Iterable, sizes, limit: int):
    """Group rows of Arrow batches into lists of about ``limit`` by ``sizes(row)``; yields lists of rows.

    Rows are tuples in the order of the batch's columns.
    """
    held, n = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            n += sizes(row)
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


def resolve_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph with bigint nodes ``a`` and ``b``.

    Alternates large-star and small-star steps; every round is written to the shared folder, so no
    lineage builds up. Joins (not windows) bring minima back to the edges, so a hub's edges can be split
    over tasks. Returns ``node, root`` (root: the smallest node reachable) for every node with an edge.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    cur = materialize(cur, "edges")
    seen = None
    for _ in range(max_rounds):
        last = cur
        both = cur.select(F.col("v").alias("u"), F.col("m").alias("n")).unionByName(
            cur.select(F.col("m").alias("u"), F.col("v").alias("n"))
        )
        low = both.groupBy("u").agg(F.min("n").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
        large = both.join(low, "u").where("n > u").select(F.col("n").alias("v"), F.col("lo").alias("m"))
        large = large.where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("lo"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("lo").alias("m")), F.struct(F.col("m").alias("v"), F.col("lo").alias("m")))).alias("e"))
        cur = materialize(small.select("e.v", "e.m").where("v <> m").distinct(), "edges")
        discard(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                cur.select(F.col("m").alias("node"), F.col("m").alias("root"))
            ).distinct()
        seen = now
    raise RuntimeError("components did not settle")
