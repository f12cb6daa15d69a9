"""Identifiers, labels, clocks, prepare records and the statistics of collectors and broadcasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import clocks, metrics, transactions
from ..sources import binary
from ..sources.changelog import change_log, table
from .registry import LINKED, query

_IDS = """CASE event_id % 7 WHEN 0 THEN 'node-' || user_id || '-' || printf('%08x', event_id) || '-' || printf('%04x', user_id) WHEN 1 THEN 'a-b-c-' || printf('%x', event_id) || '-' || printf('%x', user_id)
 WHEN 2 THEN 'n-' || printf('%x', event_id) || '-' || printf('%x', user_id) WHEN 3 THEN 'nodash' WHEN 4 THEN 'node-1-zz-' || printf('%x', user_id) WHEN 5 THEN 'node-1-' || printf('%x', event_id) || '-fffffffff' ELSE '' END"""


@query(f"""WITH e AS (SELECT event_id, {_IDS} AS request_id FROM events), p AS (SELECT *, string_split(request_id, '-') AS p, len(string_split(request_id, '-')) AS n FROM e)
SELECT event_id, request_id, CASE WHEN n >= 3 THEN array_to_string(p[1:n - 2], '-') ELSE '' END AS node,
 CASE WHEN n >= 3 AND regexp_full_match(p[n - 1], '[0-9a-f]+') THEN CAST('0x' || p[n - 1] AS BIGINT) ELSE 0 END AS second,
 CASE WHEN n >= 4 AND regexp_full_match(p[n], '[0-9a-f]+') AND CAST('0x' || p[n] AS BIGINT) < 4294967296 THEN CAST('0x' || p[n] AS BIGINT) ELSE 0 END AS seq FROM p""")
def request_getters(spark, sf_dir):
    """What can be read of request ids, well formed or not."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_IDS).alias("request_id"))
    return e.select("event_id", "request_id", *(c.alias(n) for c, n in zip(codec.request_getters(F.col("request_id")), ("node", "second", "seq"), strict=True)))


_SOURCES = "CASE p_partkey % 7 WHEN 0 THEN 'hlc:clock:tick' WHEN 1 THEN ' wal : writer : flush ' WHEN 2 THEN 'a:b' WHEN 3 THEN 'transaction: :commit' WHEN 4 THEN '' WHEN 5 THEN 'a:b:c:d' ELSE 'cache:' || p_size || ':send' END"


@query(f"""WITH s AS (SELECT p_partkey AS key, {_SOURCES} AS source_id FROM part), t AS (SELECT *, list_transform(string_split(source_id, ':'), lambda x: trim(x)) AS p FROM s), o AS (SELECT *, len(p) = 3 AND NOT list_contains(p, '') AS ok FROM t)
SELECT key, source_id, CASE WHEN ok THEN p[1] END AS module, CASE WHEN ok THEN p[2] END AS sub_module, CASE WHEN ok THEN p[3] END AS action, CASE WHEN ok THEN CASE WHEN p[1] IN ('hlc', 'wal', 'transaction', 'replication') THEN 'per-core' ELSE 'pool' END END AS mode FROM o""")
def source_mode(spark, sf_dir):
    """Source ids taken apart, and where their tasks run."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr(_SOURCES).alias("source_id"))
    x = s.withColumn("x", codec.source_parts(F.col("source_id")))
    return x.select("key", "source_id", "x.module", "x.sub_module", "x.action", F.when(F.col("x").isNotNull(), codec.source_mode(F.col("x.module"))).alias("mode"))


@query("""WITH c AS (SELECT event_id % 12 AS code, count(*) AS n FROM events GROUP BY 1)
SELECT code, coalesce(['queued', 'executing', 'passed', 'failed', 'timeout', 'busy', 'retrying', 'completed'][code + 1], 'unknown') AS state,
 coalesce(['critical', 'high', 'urgent', 'important', 'normal-high', 'normal', 'normal-low', 'low', 'background', 'idle'][code + 1], 'unknown') AS priority, n FROM c""")
def task_labels(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 12).alias("code")).agg(F.count("*").alias("n"))
    return g.select("code", codec.label(F.col("code"), codec.TASK_STATES).alias("state"), codec.label(F.col("code"), codec.PRIORITIES).alias("priority"), "n")


@query("""WITH e AS (SELECT event_id, user_id % 4 AS node, event_id // 500 AS physical FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY event_id) AS i FROM e),
p AS (SELECT event_id, node, physical, i + greatest(65500, max((physical << 16) - i) OVER (PARTITION BY node ORDER BY event_id)) AS packed FROM i)
SELECT event_id, node, physical, CAST(packed AS BIGINT) AS packed, CAST(packed >> 16 AS BIGINT) AS pt, CAST(packed & 65535 AS BIGINT) AS c FROM p""")
def hlc_now(spark, sf_dir):
    """Stamps of nodes' clocks whose counters begin almost full and carry over."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("node"), F.expr("event_id div 500").alias("physical"))
    got = clocks.now(e, "node", "event_id", F.col("physical"), 65500)
    return got.withColumns({"pt": F.shiftrightunsigned("packed", 16), "c": F.col("packed").bitwiseAND(F.lit(65535).cast("bigint"))})


@query("""SELECT o_orderkey AS task_id, 7 AS expected, count(l_orderkey) AS answered, greatest(7 - count(l_orderkey), 0) AS pending, count(l_orderkey) >= 7 AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def quorum_pending(spark, sf_dir):
    """Peers that have not answered yet, of seven asked by each task."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(7).alias("expected"))
    return metrics.pending(tasks, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id")))


@query("""WITH g AS (SELECT coalesce(event_type, 'all') AS op, count(*) AS ops FROM events GROUP BY ROLLUP (event_type)), w AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS wall FROM events)
SELECT op, ops, wall AS wall_s, CASE WHEN wall = 0 THEN 0.0 ELSE ops / wall END AS per_second FROM g, w""")
def throughput(spark, sf_dir):
    """Operations per second of a collector's wall time, by kind and in all."""
    at = F.expr("unix_micros(cast(ts as timestamp))")
    g = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("ops"), F.min(at).alias("low"), F.max(at).alias("high"))
    whole = Window.partitionBy(F.lit(1))  # a row for each kind
    g = g.withColumn("wall_s", (F.max("high").over(whole) - F.min("low").over(whole)) / F.lit(1000000.0))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("op"), "ops", "wall_s", metrics.ratio(F.col("ops"), F.col("wall_s")).alias("per_second"))


@query(LINKED + """, f AS (SELECT *, row_number() OVER (PARTITION BY tx_id, key ORDER BY ts) AS i, row_number() OVER (PARTITION BY tx_id, key ORDER BY ts DESC) AS d FROM p),
g AS (SELECT tx_id, key, max(CASE WHEN i = 1 THEN prev_ts END) AS old_ts, bool_or(i = 1 AND prev_ts IS NOT NULL AND NOT prev_del) AS had, max(ts) AS ts, bool_or(d = 1 AND del) AS del FROM f GROUP BY ALL),
o AS (SELECT *, CASE WHEN del THEN CASE WHEN had THEN 2 END WHEN had THEN 1 ELSE 0 END AS op FROM g)
SELECT tx_id, key, op, CASE WHEN old_ts IS NOT NULL AND NOT had THEN 1 ELSE 0 END AS old_flag, coalesce(old_ts, 0) AS old_ts, CASE WHEN had THEN 'v' || old_ts ELSE '' END AS old_value, CASE WHEN op = 2 THEN 1 ELSE 0 END AS new_flag, CASE WHEN op = 2 THEN '' ELSE 'v' || ts END AS value FROM o WHERE op IS NOT NULL""")
def prepare_records(spark, sf_dir):
    """Write sets as prepare entries, a record of old and new value for each key in byte order, and read back."""
    back = binary.decode_prepared(transactions.prepare_entries(change_log(spark, sf_dir)))
    text = lambda c: F.col(c).cast("string")
    return back.select("tx_id", text("key").cast("bigint").alias("key"), "op", "old_flag", "old_ts", text("old_value").alias("old_value"), "new_flag", text("value").alias("value"))
