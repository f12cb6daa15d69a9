"""Versions of keys: newest, as of a timestamp, previous, pruned.

Newest versions come from ``max_by`` aggregates, which combine on the map side, so a hot key costs one
partial row for each task. Only operators that need a version's predecessor sort a key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key, tombstones included."""
    by = by or ("key",)
    # Primitive fields, one by one: a struct would force a sort aggregate.
    return log.groupBy(*by).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"), F.max_by("is_deleted", "ts").alias("is_deleted"))


def live(log: DataFrame) -> DataFrame:
    """The newest version of each key that is not deleted: ``key, value, ts``."""
    return newest(log).where(~F.col("is_deleted")).select("key", "value", "ts")


def as_of(log: DataFrame, ts: int, mode: str = "full") -> DataFrame:
    """Values visible to a snapshot.

    ``full`` searches the whole history. ``inline2`` sees only the current version and the one before it, and
    not even that one if the current version was an insert.
    """
    if mode == "full":
        return live(log.where(F.col("ts") <= ts))
    pair = F.slice(F.sort_array(F.collect_list(F.struct("ts", "is_deleted", "value")), asc=False), 1, 2)
    two = _newest_two(log).groupBy("key").agg(pair.alias("p")).select("key", F.get("p", F.lit(0)).alias("cur"), F.get("p", F.lit(1)).alias("prev"))
    seen = F.when(F.col("cur.ts") <= ts, F.col("cur")).when((F.col("prev.ts") <= ts) & ~F.col("prev.is_deleted"), F.col("prev"))
    return two.select("key", seen.alias("x")).where("x is not null and not x.is_deleted").select("key", "x.value", "x.ts")


def _newest_two(log: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))  # window group limit: at most two rows a key and task are shuffled
    return log.withColumn("__r", rank).where("__r <= 2").drop("__r")


def with_previous(log: DataFrame) -> DataFrame:
    """Each version with ``prev_ts, prev_value, prev_deleted`` of the one before it."""
    w = Window.partitionBy("key").orderBy("ts")
    return log.withColumn("__p", F.lag(F.struct("ts", "value", "is_deleted")).over(w)).select(*log.columns, F.col("__p.ts").alias("prev_ts"), F.col("__p.value").alias("prev_value"), F.col("__p.is_deleted").alias("prev_deleted"))


def existed(prev_deleted: Column) -> Column:
    """Whether there was a value before a version."""
    return F.coalesce(~prev_deleted, F.lit(False))


def prune(log: DataFrame, watermark: int, newest_kept: int) -> DataFrame:
    """Versions that garbage collection keeps: the newest few, and the newest one at or under the watermark."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))
    base = log.where(F.col("ts") <= watermark).groupBy("key").agg(F.max("ts").alias("__base"))
    return log.withColumn("__r", rank).join(base, "key", "left").where((F.col("__r") <= newest_kept) | (F.col("ts") == F.col("__base"))).select(log.columns)


def lookup(keys: DataFrame, state: DataFrame) -> DataFrame:
    """``keys`` (with repeats) left-joined to a state of one row a key; missing keys get nulls."""
    return keys.join(state.select("key", "value"), "key", "left")


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A base state under newer changes (``key, value, is_deleted``); a change hides the base even if it deletes."""
    c = changes.select("key", F.col("value").alias("__v"), F.col("is_deleted").alias("__d"), F.lit(True).alias("__present"))
    out = base.select("key", "value").join(c, "key", "full_outer")
    present = F.coalesce("__present", F.lit(False))
    return out.select("key", F.when(present, F.when(~F.col("__d"), F.col("__v"))).otherwise(F.col("value")).alias("value"), present.alias("changed"), F.coalesce("__d", F.lit(False)).alias("is_deleted"))
