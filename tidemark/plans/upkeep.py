"""Compaction, checkpoints, metrics, quorum and scheduling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compaction, metrics, sequences, versions
from ..sources.changelog import change_log, chunk_pages, table
from .registry import LOG, query

_DEAD = "event_type IN ('error', 'click', 'view')"
_CHUNKS = """WITH pg AS (SELECT l_orderkey // 100 AS chunk_id, CAST(l_quantity AS BIGINT) * 80 AS length,
  CASE WHEN (l_orderkey // 100) % 10 = 0 THEN true WHEN (l_orderkey // 100) % 3 = 0 THEN l_returnflag <> 'A' ELSE l_returnflag = 'R' END AS removed FROM lineitem),
c AS (SELECT chunk_id, count(*) AS n_pages, count(*) FILTER (WHERE removed) AS free_pages, CAST(sum(length) AS BIGINT) AS total, CAST(sum(CASE WHEN removed THEN 0 ELSE length END) AS BIGINT) AS live FROM pg GROUP BY 1),
f AS (SELECT *, CASE WHEN total > 0 THEN 1 + 98 * live // total ELSE 1 END AS fill FROM c)"""


@query(f"""WITH s AS (SELECT user_id % 16 AS page, event_id AS ts, {_DEAD} AS dead, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events),
p AS (SELECT page, count(*) AS total, count(*) FILTER (WHERE dead AND ts < (SELECT max(event_id) - 20 FROM events)) AS droppable FROM s WHERE r = 1 GROUP BY page)
SELECT page, total, droppable, droppable * 2 > total AS compacted, total - CASE WHEN droppable * 2 > total THEN droppable ELSE 0 END AS survivors FROM p""")
def tombstone_compact(spark, sf_dir):
    """Pages whose tombstones under the watermark are over half of their entries drop them."""
    events = table(spark, sf_dir, "events")
    mark = events.agg(F.max("event_id")).first()[0] - 20
    log = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), F.expr(_DEAD).alias("is_deleted"), "value")
    return compaction.tombstone_pages(versions.newest(log).withColumn("page", F.col("key") % 16), mark)


@query("SELECT doc_id AS lob_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dead_lobs(spark, sf_dir):
    """Large objects that no live version refers to."""
    lobs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return lobs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "lob_id")


@query("""WITH o AS (SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS BIGINT) * 80) AS BIGINT) AS size FROM lineitem GROUP BY 1)
SELECT key, size, CAST((sum(size) OVER (ORDER BY key) - size) // 65536 AS BIGINT) AS chunk_id FROM o""")
def chunk_pack(spark, sf_dir):
    """Chunk of each object when chunks of 64 KiB fill up in key order."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint") * 80).alias("size"))
    return sequences.running(sizes, "key", F.col("size"), "__end").select("key", "size", F.expr("(__end - size) div 65536").alias("chunk_id"))


@query(_CHUNKS + " SELECT chunk_id, n_pages, free_pages, total, live, fill FROM f")
def chunk_stats(spark, sf_dir):
    return compaction.fill_rates(chunk_pages(spark, sf_dir))


@query(_CHUNKS + """, k AS (SELECT chunk_id, fill, live, CAST(sum(live) OVER (ORDER BY fill, live, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_live FROM f
WHERE chunk_id < (SELECT max(chunk_id) FROM f) AND (live = 0 OR fill <= 30)) SELECT * FROM k WHERE live = 0 OR cum_live <= 1000000""")
def chunk_pick(spark, sf_dir):
    return compaction.pick_chunks(compaction.fill_rates(chunk_pages(spark, sf_dir)), 30, 1_000_000)


@query(_CHUNKS + """, k AS (SELECT chunk_id, live, sum(live) OVER (ORDER BY fill, live, chunk_id ROWS UNBOUNDED PRECEDING) AS cum FROM f
WHERE chunk_id < (SELECT max(chunk_id) FROM f) AND (live = 0 OR fill <= 30)), picked AS (SELECT chunk_id FROM k WHERE live = 0 OR cum <= 1000000)
SELECT chunk_id IN (SELECT chunk_id FROM picked) AS rewritten, count(*) AS n_pages, CAST(sum(length) AS BIGINT) AS bytes FROM pg WHERE NOT removed GROUP BY 1""")
def chunk_rewrite(spark, sf_dir):
    """Live pages after compaction: those moved out of picked chunks and those left in place."""
    pages = chunk_pages(spark, sf_dir)
    picked = compaction.pick_chunks(compaction.fill_rates(pages), 30, 1_000_000).select("chunk_id", F.lit(True).alias("picked"))
    return pages.where("not removed").join(picked, "chunk_id", "left").groupBy(F.coalesce("picked", F.lit(False)).alias("rewritten")).agg(F.count("*").alias("n_pages"), F.sum("length").alias("bytes"))


@query("""SELECT o_custkey AS chunk_id, max(o_orderkey) AS seq, 'btree_' || o_custkey || '_' || max(o_orderkey) || '.ao' AS name FROM orders WHERE o_totalprice >= 20000 GROUP BY o_custkey""")
def chunk_restore(spark, sf_dir):
    """A chunk folder's valid files: non-empty, parsable, highest sequence of each id."""
    size = F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice").cast("bigint")).otherwise(0)
    return compaction.newest_files(table(spark, sf_dir, "orders").select(F.concat_ws("", F.lit("btree_"), "o_custkey", F.lit("_"), "o_orderkey", F.lit(".ao")).alias("name"), size.alias("size")))


@query(LOG + " SELECT ts // 1000 AS checkpoint, min(ts) AS start_lsn, count(*) AS n_ops, count(DISTINCT key) AS dirty_keys FROM l GROUP BY 1")
def checkpoint_plan(spark, sf_dir):
    return compaction.checkpoints(change_log(spark, sf_dir), 1000)


@query(LOG + " SELECT ts // 300 AS segment, min(ts) AS first_lsn, max(ts) AS last_lsn, max(ts) >= 7000 AS kept FROM l GROUP BY 1")
def wal_truncate(spark, sf_dir):
    """Segments that hold anything from the checkpoint's start on are kept."""
    return compaction.truncate(change_log(spark, sf_dir), 7000, 300)


@query("""WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS reads, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS writes, count(*) FILTER (WHERE event_type = 'error') AS deletes, count(*) FILTER (WHERE event_type = 'signup') AS retries FROM events)
SELECT *, reads + writes + deletes AS total_ops, CASE WHEN writes = 0 THEN 0.0 ELSE CAST(retries AS DOUBLE) / writes END AS conflict_rate FROM c""")
def op_counters(spark, sf_dir):
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").agg(F.count_if(kind == "view").alias("reads"), F.count_if(kind.isin("purchase", "click")).alias("writes"), F.count_if(kind == "error").alias("deletes"), F.count_if(kind == "signup").alias("retries"))
    return c.withColumn("total_ops", F.expr("reads + writes + deletes")).withColumn("conflict_rate", metrics.ratio(F.col("retries"), F.col("writes")))


@query("""WITH h AS (SELECT epoch(date_trunc('hour', ts)) // 3600 AS hour, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(hour AS BIGINT) AS hour, n, n / 3600.0 AS qps, CAST(n - lag(n) OVER (ORDER BY hour) AS BIGINT) AS delta FROM h""")
def qps(spark, sf_dir):
    """Operations per second by hour and the change from the hour before; the window runs over hours."""
    h = table(spark, sf_dir, "events").groupBy(F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour")).agg(F.count("*").alias("n"))
    return h.select("hour", "n", (F.col("n") / F.lit(3600.0)).alias("qps"), (F.col("n") - F.lag("n").over(Window.orderBy("hour"))).alias("delta"))


_US = "CAST(floor(value * 10) AS BIGINT)"


@query(f"""WITH s AS (SELECT {_US} AS us FROM events), b AS (SELECT CASE WHEN us = 0 THEN 0 ELSE length(bin(us)) END AS bucket, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT CAST(bucket AS INT) AS bucket, CAST(1 AS BIGINT) << bucket AS upper, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM b)
SELECT bucket, upper, n, cum, min(CASE WHEN cum >= total * 50 // 100 THEN upper END) OVER () AS p50, min(CASE WHEN cum >= total * 95 // 100 THEN upper END) OVER () AS p95,
  min(CASE WHEN cum >= total * 99 // 100 THEN upper END) OVER () AS p99 FROM c""")
def latency_pow2(spark, sf_dir):
    return metrics.power_histogram(table(spark, sf_dir, "events").select(F.floor(F.col("value") * 10).cast("bigint").alias("us")), "us")


@query(f"""WITH s AS (SELECT event_type AS op, {_US} AS us FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY op) AS n FROM s)
SELECT op, max(n) AS n, max(CASE WHEN i = (n - 1) * 50 // 100 THEN us END) AS p50, max(CASE WHEN i = (n - 1) * 95 // 100 THEN us END) AS p95, max(CASE WHEN i = (n - 1) * 99 // 100 THEN us END) AS p99,
  CAST(sum(us) // count(*) AS BIGINT) AS avg_us, min(us) AS min_us, max(us) AS max_us, CAST(sum(us) AS BIGINT) AS total_us FROM r GROUP BY op""")
def latency_exact(spark, sf_dir):
    return metrics.exact_percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.floor(F.col("value") * 10).cast("bigint").alias("us")), "op", "us")


@query("""WITH b AS (SELECT CAST(CASE WHEN value >= 100 THEN 10 ELSE floor(value / 10.0) END AS INT) AS bucket, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total, CAST((bucket + 0.5) * 10.0 AS DOUBLE) AS mid FROM b)
SELECT bucket, n, cum, min(CASE WHEN cum >= total * 50 // 100 THEN mid END) OVER () AS p50, min(CASE WHEN cum >= total * 95 // 100 THEN mid END) OVER () AS p95,
  min(CASE WHEN cum >= total * 99 // 100 THEN mid END) OVER () AS p99 FROM c""")
def latency_fixed(spark, sf_dir):
    return metrics.fixed_histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10)


@query("""SELECT coalesce(event_type, 'all') AS op, count(*) AS ops, count(*) FILTER (WHERE value < 5) AS errors, CAST(count(*) FILTER (WHERE value < 5) AS DOUBLE) / count(*) AS error_rate FROM events GROUP BY ROLLUP (event_type)""")
def metrics_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("ops"), F.count_if(F.col("value") < 5).alias("errors"))
    return r.select(F.coalesce("event_type", F.lit("all")).alias("op"), "ops", "errors", metrics.ratio(F.col("errors"), F.col("ops")).alias("error_rate"))


@query("""WITH r AS (SELECT l_orderkey AS task_id, l_linestatus = 'F' AS ok, l_shipdate AS t, row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'F' ORDER BY l_shipdate) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT task_id, count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS success_rate, count(*) FILTER (WHERE ok) >= count(*) // 2 + 1 AS majority_ok,
  count(*) FILTER (WHERE NOT ok) = 0 AS all_ok, min(t) AS first_at, max(CASE WHEN ok AND i = n // 2 + 1 THEN t END) AS majority_at FROM r GROUP BY task_id""")
def quorum_stats(spark, sf_dir):
    """Scatter-gather outcomes of each order's peers."""
    peers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_shipdate").alias("at"))
    return metrics.quorum(peers.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id")), "task_id", "left_semi"))


@query("""SELECT o_orderkey AS page, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS age_days FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') > 1000 ORDER BY age_days DESC, page""")
def leak_report(spark, sf_dir):
    """Pages allocated and never freed for more than a thousand days, oldest first."""
    freed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("page"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")).cast("bigint").alias("age_days"))
    return pages.where("age_days > 1000").join(freed, "page", "left_anti").orderBy(F.desc("age_days"), "page")


@query("""WITH c AS (SELECT abs(l_suppkey) % 8 AS core, count(*) AS load FROM lineitem GROUP BY 1)
SELECT core, load, core = (SELECT arg_min(core, load * 1000 + core) FROM c) AS least FROM c""")
def least_loaded(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy((F.abs("l_suppkey") % 8).alias("core")).agg(F.count("*").alias("load"))
    return c.withColumn("least", F.col("core") == F.min_by("core", F.col("load") * 1000 + F.col("core")).over(Window.partitionBy(F.lit(1))))  # one row a core


_LEVEL = "CASE WHEN event_id < 2000 THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN 2 ELSE 5 END"


@query(f"""SELECT event_id, level, row_number() OVER (ORDER BY level, event_id) AS turn FROM (SELECT event_id, CAST({_LEVEL} AS INT) AS level FROM events)""")
def priority_pop(spark, sf_dir):
    """Pop order: by level, first in first out; items that waited too long are promoted to level 0."""
    items = table(spark, sf_dir, "events").select("event_id", F.expr(_LEVEL).cast("int").alias("level")).withColumn("place", F.col("level").cast("bigint") * (1 << 40) + F.col("event_id"))
    return sequences.numbered(items, "place", "turn").select("event_id", "level", "turn")


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events)
SELECT (rn - 1) // 16 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY 1""")
def group_commit_batches(spark, sf_dir):
    n = sequences.numbered(table(spark, sf_dir, "events").select("event_id"), "event_id", "rn")
    return n.groupBy(F.expr("(rn - 1) div 16").alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH c AS (SELECT user_id AS peer, event_id AS seq, event_type IN ('error', 'view') AS failed FROM events),
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY peer ORDER BY seq) AS run FROM c),
s AS (SELECT peer, run, count(*) AS n, count(*) FILTER (WHERE failed) AS bad FROM g GROUP BY ALL), p AS (SELECT peer, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(bad) AS BIGINT) AS failures, max(bad) AS longest_streak FROM s GROUP BY peer)
SELECT *, (requests >= 10 AND failures >= 0.5 * requests) OR longest_streak >= 5 AS tripped FROM p""")
def circuit_trip(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "view").alias("failed"))
    return metrics.trips(calls)


@query("""SELECT event_type AS op, count(*) AS messages, CAST(sum(length(props)) AS BIGINT) AS bytes, max(length(props)) AS largest FROM events GROUP BY 1""")
def transport_metrics(spark, sf_dir):
    """Counts and sizes of messages by operation."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("messages"), F.sum(F.length("props")).alias("bytes"), F.max(F.length("props")).cast("bigint").alias("largest"))
