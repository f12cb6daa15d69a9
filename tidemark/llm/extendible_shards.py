"""Sharding by extendible hashing, in DataFrame operations.

Every row has 60 hash bits. A directory of hash prefixes starts with one bucket; only a bucket over the
byte limit splits, on the next bit, until each fits. Sizes of all prefixes come from one histogram of the
``span`` leading bits (rolled up level by level), so a round costs one aggregation however many splits it
holds; buckets still too large go to the next round on their following bits. Rows whose 60 bits are all
equal (repeated ids) get fresh bits from a row number and split on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LIMIT = 16 << 20
BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column) -> Column:
    """The leading ``depth`` bits."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def _buckets(rows: DataFrame, base: int, span: int, limit: int) -> DataFrame:
    """``fine, depth, shard_bytes, shard_rows`` for each prefix of ``base + span`` bits.

    ``depth``: the least depth from ``base`` on at which the bucket fits or holds a single row; null if none does.
    """
    fine = rows.groupBy(prefix(F.col("__h"), F.lit(base + span)).alias("fine")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"))
    levels = fine.select("fine", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(span))).alias("level"))
    node = F.call_function("shiftright", F.col("fine"), F.lit(span) - F.col("level"))
    sizes = levels.groupBy("level", node.alias("node")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sizes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    best = levels.select("fine", "level", node.alias("node")).join(fits, ["level", "node"]).groupBy("fine").agg(F.min(F.struct("level", "shard_bytes", "shard_rows")).alias("x"))
    return best.select("fine", (F.col("x.level") + base).alias("depth"), "x.shard_bytes", "x.shard_rows")


def assign_shards(rows: DataFrame, key: str = "doc_id", limit: int = LIMIT, text_col: str = "text", hashed: Column | None = None, size_col: str | None = None) -> DataFrame:
    """``rows``, all columns, with ``shard`` (the bits of its prefix; '' for the root), ``shard_bytes`` and ``shard_rows``.

    A shard's texts hold at most ``limit`` UTF-8 bytes; a single row that is larger is a shard of its own.
    Null text counts as 0 bytes, a null key as ''. Repeated keys share their bits until those run out and are
    then told apart by row. ``hashed`` replaces the hash bits (tests); ``size_col``
    gives the bytes of rows that carry no text. Empty input: empty output. Columns of
    ``rows`` with the names of the new ones are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "shard_bytes", "shard_rows")]
    left = rows.withColumns({"__h": hashed if hashed is not None else hash_bits(F.col(key)), "__bytes": F.coalesce(F.col(size_col) if size_col else F.octet_length(text_col), F.lit(0)).cast("bigint")})
    base, lead, done = 0, "", []
    while True:
        total, n = left.agg(F.sum("__bytes"), F.count("*")).first()
        if not n:
            break
        span = min(BITS - base, max(4, math.ceil(math.log2(max(1, total / limit))) + 5))
        known = _buckets(left, base, span, limit)
        placed = left.withColumn("__fine", prefix(F.col("__h"), F.lit(base + span))).join(known.select(*(F.col(c).alias(f"__{c}") for c in known.columns)), "__fine", "left")
        bits = F.when(F.col("__depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix(F.col("__h"), F.col("__depth")).cast("string"), 10, 2), F.col("__depth").cast("int"), F.lit("0")))
        done.append(placed.where("__depth is not null").select(*kept, F.concat(F.lit(lead), bits).alias("shard"), F.col("__shard_bytes").alias("shard_bytes"), F.col("__shard_rows").alias("shard_rows")))
        over = left.groupBy(prefix(F.col("__h"), F.lit(base + span)).alias("f")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1))
        if over.isEmpty():
            break
        left = materialize(placed.where("__depth is null").select(*kept, "__h", "__bytes"), "oversized")
        base += span
        if base >= BITS:
            left = materialize(left.withColumn("__h", hash_bits(F.concat_ws("#", F.col("__h"), F.monotonically_increasing_id()))), "oversized")
            base, lead = 0, lead + "+"
    if not done:
        return rows.select(*kept, F.lit("").alias("shard"), F.lit(0).cast("bigint").alias("shard_bytes"), F.lit(0).cast("bigint").alias("shard_rows"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


ORACLE = f"""
WITH d AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS x, coalesce(strlen(text), 0) AS b FROM documents
), h AS (SELECT *, CAST(('0x' || x) AS BIGINT) AS h FROM d
), lv AS (SELECT doc_id, b, depth, h >> (60 - depth) AS node FROM h, range(0, 25) r(depth)
), sz AS (SELECT depth, node, sum(b) AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY ALL
), ok AS (SELECT lv.doc_id, min(depth) AS least FROM lv JOIN sz USING (depth, node) WHERE shard_bytes <= {LIMIT} OR shard_rows = 1 GROUP BY ALL)
SELECT h.doc_id, CASE WHEN least = 0 THEN '' ELSE lpad(bin(h.h >> (60 - least)), CAST(least AS INT), '0') END AS shard,
       CAST(sz.shard_bytes AS BIGINT) AS shard_bytes, CAST(sz.shard_rows AS BIGINT) AS shard_rows
FROM h JOIN ok USING (doc_id) JOIN sz ON sz.depth = ok.least AND sz.node = h.h >> (60 - ok.least)
"""
