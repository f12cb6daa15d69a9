"""Compaction: tombstones, chunk fill rates, greedy picks, checkpoints and log truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tombstone_pages(state: DataFrame, watermark: int) -> DataFrame:
    """Pages of a state (``page, ts, is_deleted``): droppable tombstones and whether over half of the page can go."""
    drop = F.col("is_deleted") & (F.col("ts") < watermark)
    out = state.groupBy("page").agg(F.count("*").alias("total"), F.count_if(drop).alias("droppable"))
    return out.withColumn("compacted", F.col("droppable") * 2 > F.col("total")).withColumn("survivors", F.col("total") - F.when(F.col("compacted"), F.col("droppable")).otherwise(0))


def fill_rates(pages: DataFrame) -> DataFrame:
    """``chunk_id, n_pages, free_pages, total, live, fill``: fill is 1 + floor(98 live / total), 1 for an empty chunk."""
    out = pages.groupBy("chunk_id").agg(
        F.count("*").alias("n_pages"), F.count_if("removed").alias("free_pages"), F.sum("length").alias("total"),
        F.sum(F.when(~F.col("removed"), F.col("length")).otherwise(0)).alias("live"),
    )
    return out.withColumn("fill", F.when(F.col("total") > 0, 1 + F.expr("98 * live div total")).otherwise(F.lit(1).cast("bigint")))


def pick_chunks(chunks: DataFrame, most_fill: int, budget: int) -> DataFrame:
    """Chunks to rewrite: empty ones, and sparse ones by (fill, live, id) while their live bytes fit the budget.

    The last chunk is never picked. The window runs over chunk summaries, not pages.
    """
    last = F.max("chunk_id").over(Window.partitionBy(F.lit(1)))
    cand = chunks.withColumn("__last", last).where(F.col("chunk_id") < F.col("__last")).where((F.col("live") == 0) | (F.col("fill") <= most_fill))
    order = Window.orderBy("fill", "live", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return cand.withColumn("cum_live", F.sum("live").over(order)).where((F.col("live") == 0) | (F.col("cum_live") <= budget)).select("chunk_id", "fill", "live", "cum_live")


def checkpoints(log: DataFrame, every: int) -> DataFrame:
    """A fuzzy checkpoint for each ``every`` entries: where replay starts and how many keys were dirty."""
    return log.groupBy(F.expr(f"ts div {every}").alias("checkpoint")).agg(F.min("ts").alias("start_lsn"), F.count("*").alias("n_ops"), F.countDistinct("key").alias("dirty_keys"))


def truncate(log: DataFrame, start: int, size: int) -> DataFrame:
    """Log segments, and whether a checkpoint that starts at ``start`` keeps them (any entry at or after it)."""
    out = log.groupBy(F.expr(f"ts div {size}").alias("segment")).agg(F.min("ts").alias("first_lsn"), F.max("ts").alias("last_lsn"))
    return out.withColumn("kept", F.col("last_lsn") >= start)


def newest_files(files: DataFrame) -> DataFrame:
    """Chunk files ``name, size``: the highest sequence of each id among parsable, non-empty files."""
    parsed = files.where("size > 0").select("name", F.regexp_extract("name", r"^btree_(\d+)_(\d+)\.ao$", 1).alias("i"), F.regexp_extract("name", r"^btree_(\d+)_(\d+)\.ao$", 2).alias("s")).where("i <> ''")
    return parsed.groupBy(F.col("i").cast("bigint").alias("chunk_id")).agg(F.max(F.col("s").cast("bigint")).alias("seq"), F.max_by("name", F.col("s").cast("bigint")).alias("name"))


def tombstone_ratios(state: DataFrame) -> DataFrame:
    """Entries, tombstones and their ratio of each ``page`` of a state with tombstones."""
    out = state.groupBy("page").agg(F.count("*").alias("entries"), F.count_if("is_deleted").alias("tombstones"))
    return out.withColumn("ratio", F.col("tombstones") / F.col("entries"))


def reclaimable(retired: DataFrame, readers: DataFrame) -> DataFrame:
    """Per ``epoch`` of retired pages, whether it lies before the epochs of all active readers."""
    safe = readers.agg(F.min("epoch").alias("safe"))  # one row
    out = retired.groupBy("epoch").agg(F.count("*").alias("pages")).join(F.broadcast(safe))
    return out.select("epoch", "pages", F.coalesce(F.col("epoch") < F.col("safe"), F.lit(True)).alias("reclaimable"))


def triggers(writes: DataFrame, every: int, idle_ms: int) -> DataFrame:
    """Writes (``store, seq, at`` in ms) at which a store's checkpoint starts, by count or after an idle time."""
    w = Window.partitionBy("store").orderBy("seq")
    by_count = F.row_number().over(w) % every == 0
    by_idle = F.coalesce(F.col("at") - F.lag("at").over(w) > idle_ms, F.lit(False))
    return writes.select("store", "seq", by_count.alias("by_count"), by_idle.alias("by_idle")).where("by_count or by_idle")
