"""Seeded key generators as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, low: int = 0, high: int = 10_000) -> Column:
    return F.floor(F.rand(seed) * (high - low)).cast("bigint") + low


def zipf(seed: int, s: float = 1.5, v: float = 2.0, high: int = 10_000) -> Column:
    """Approximate Zipf ranks by the inverse of the continuous distribution with density (v + x) ** -s."""
    a, b = v ** (1 - s), (v + high) ** (1 - s)
    return F.floor(F.pow(F.lit(a) - F.rand(seed) * F.lit(a - b), F.lit(1 / (1 - s))) - v).cast("bigint")


def hotspot(seed: int, hot: int = 10, share: float = 0.8, high: int = 10_000) -> Column:
    return F.when(F.rand(seed) < share, uniform(seed + 1, 0, hot)).otherwise(uniform(seed + 2, hot, high))


def all_kinds(spark: SparkSession, n: int, seed: int = 42, value_size: int = 16) -> DataFrame:
    """``kind, id, key, value``; the value is printable."""
    rows = spark.range(n)
    kinds = {"uniform": uniform(seed), "zipf": zipf(seed + 10), "sequential": F.col("id"), "hotspot": hotspot(seed + 20)}
    out = [rows.select(F.lit(k).alias("kind"), "id", F.format_string("test-key-%d", c).alias("key"), F.substring(F.md5(F.concat(F.lit(k), F.col("id"))), 1, value_size).alias("value")) for k, c in kinds.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]
