"""Token counts behind a digest cache.

Content is normalised (runs of ASCII white space become one space, ends trimmed; null is empty), which
leaves the counts of tokenizers that drop white space as they are. The SHA-256 of the content with the
tokenizer's version digest is joined to stored counts; one row for each distinct miss is encoded and its count is appended to the cache, a Parquet table in a folder that all executors share.

While encoding, a worker remembers the count of each piece between white space: the tokenizer never
merges over white space, so the counts add up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import materialize, scratch, small_batches

CACHE = "version string, digest binary, n_tokens bigint"
#: Pieces remembered by a worker.
MEMO = 1_000_000


class PieceCounter:
    """Counts of whole texts, as the library's encode gives them."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(definition), {}

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        split = [t.split(" ") for t in texts]
        missing = [p for p in set().union(*split) if p not in known]
        if len(known) + len(missing) > MEMO:
            known.clear()
            missing = list(set().union(*split))
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            known.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


def _encoder(definition: str):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(definition)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.count(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def normalised(text):
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty if nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, definition: str, cache_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row (one per input row, repeated rows included).

    ``definition`` is the JSON of a tokenizer that drops white space. ``cache_path``: where counts are kept
    from call to call; None starts an empty cache in the shared folder. Null text counts as empty: 0 bytes,
    0 tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = cache_path or scratch(spark, "token-cache")
    version = hashlib.sha256(definition.encode()).hexdigest()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        normalised(F.col("text")).alias("content"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    stored = read_cache(spark, path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    seen = materialize(rows.select("doc_id", "n_bytes", "digest"), "digests")
    key = F.coalesce("doc_id", F.lit(0)).alias("key")  # any one will do: equal digests are equal contents
    misses = seen.groupBy("digest").agg(F.min(key).alias("key")).join(stored, "digest", "left_anti")
    # Rows that repeat meet in each task before they travel, so a hot row is sent once by each.
    todo = rows.groupBy(key, "digest").agg(F.first("content").alias("content")).join(misses, ["key", "digest"], "left_semi")
    fresh = todo.select("digest", "content").mapInArrow(_encoder(definition), "digest binary, n_tokens bigint")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(path)
    counts = read_cache(spark, path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that both sides of the join are plain exchanges and a hot digest's rows can be split
    counts = materialize(counts, "counts")
    return seen.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
