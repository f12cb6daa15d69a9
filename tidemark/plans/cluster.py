"""Strategies, batches, horizons, triggers and clocks of a cluster of stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import compaction, metrics, versions
from ..sources.changelog import change_log, table
from .registry import LOG, RANKED, query


@query(RANKED + """ SELECT key % 16 AS page, count(*) AS entries, count(*) FILTER (WHERE del) AS tombstones, CAST(count(*) FILTER (WHERE del) AS DOUBLE) / count(*) AS ratio
FROM r WHERE r = 1 GROUP BY 1""")
def tombstone_ratio(spark, sf_dir):
    """The share of tombstones among a page's entries."""
    return compaction.tombstone_ratios(versions.newest(change_log(spark, sf_dir)).withColumn("page", F.col("key") % 16))


@query("""WITH t AS (SELECT l_orderkey AS task_id, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS ok FROM lineitem GROUP BY 1)
SELECT task_id, s AS strategy, CASE s WHEN 'all' THEN ok = n WHEN 'majority' THEN ok >= n // 2 + 1 ELSE true END AS passed
FROM t, (VALUES ('all'), ('majority'), ('none')) v(s)""")
def strategy_check(spark, sf_dir):
    """Whether a task's answers satisfy each broadcast strategy."""
    peers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("ok"))
    return metrics.strategies(peers)


@query("""WITH r AS (SELECT l_orderkey AS task_id, l_linestatus = 'F' AS ok, l_shipdate AS t, row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'F' ORDER BY l_shipdate) AS i FROM lineitem)
SELECT task_id, count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE ok) >= 2 AS reached, max(CASE WHEN ok AND i = 2 THEN t END) AS reached_at
FROM r GROUP BY task_id""")
def quorum_k(spark, sf_dir):
    """Whether and when two peers had answered."""
    peers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_shipdate").alias("at"))
    return metrics.quorum_of(peers, 2)


@query("""WITH m AS (SELECT event_id AS call_id, unnest([user_id % 5, user_id % 7, event_id % 11]) AS target, unnest(['a:' || event_id, 'b:' || user_id, 'c:' || event_type]) AS payload FROM events)
SELECT target, count(*) AS messages, CAST(sum(length(payload)) AS BIGINT) AS bytes, min(payload) AS first_payload FROM m GROUP BY target""")
def write_v(spark, sf_dir):
    """Scattered writes, a message of its own for each target, by target."""
    sent = table(spark, sf_dir, "events").select(
        F.array(F.col("user_id") % 5, F.col("user_id") % 7, F.col("event_id") % 11).alias("targets"),
        F.array(F.concat(F.lit("a:"), "event_id"), F.concat(F.lit("b:"), "user_id"), F.concat(F.lit("c:"), "event_type")).alias("payloads"),
    )
    each = sent.select(F.inline(F.arrays_zip(F.col("targets").alias("target"), F.col("payloads").alias("payload"))))
    return each.groupBy("target").agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("payload").alias("first_payload"))


@query("""SELECT o_custkey AS batch, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS success, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
  min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS first_error FROM orders GROUP BY 1""")
def batch_results(spark, sf_dir):
    """Outcome of submitted batches; a failed task doesn't undo the others."""
    failed = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed"), F.min(F.when(failed, F.col("o_orderkey"))).alias("first_error")
    )


@query("SELECT user_id % 8 AS node, max(event_id) AS watermark, count(*) AS updates FROM events GROUP BY 1")
def remote_watermarks(spark, sf_dir):
    """The monotonic watermark of each node, whatever order its updates arrive in."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("node")).agg(F.max("event_id").alias("watermark"), F.count("*").alias("updates"))


@query("""WITH safe AS (SELECT min(o_orderkey) AS e FROM orders WHERE o_orderstatus = 'O')
SELECT l_orderkey AS epoch, count(*) AS pages, l_orderkey < coalesce((SELECT e FROM safe), l_orderkey + 1) AS reclaimable FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def epoch_reclaim(spark, sf_dir):
    """Retired pages by epoch; those before the oldest active reader's epoch can go (all, without a reader)."""
    readers = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("epoch"))
    retired = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("epoch"))
    return compaction.reclaimable(retired, readers)


@query("""WITH s AS (SELECT user_id AS store, event_id AS seq, row_number() OVER w AS n, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT store, seq, n % 10 = 0 AS by_count, coalesce(gap > 3600000, false) AS by_idle FROM s WHERE n % 10 = 0 OR gap > 3600000""")
def checkpoint_triggers(spark, sf_dir):
    """Where a store's checkpoint starts: after every tenth write, or after an idle hour."""
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return compaction.triggers(writes, every=10, idle_ms=3_600_000)


@query(LOG + " SELECT tx_id, ts AS lsn, lag(ts) OVER (PARTITION BY tx_id ORDER BY ts) AS prev_lsn FROM l")
def prev_lsn(spark, sf_dir):
    """Each log entry's link to the one before in its transaction."""
    w = Window.partitionBy("tx_id").orderBy("ts")
    return change_log(spark, sf_dir).select("tx_id", F.col("ts").alias("lsn"), F.lag("ts").over(w).alias("prev_lsn"))


@query("""WITH e AS (SELECT event_id, event_id // 3 AS p, event_id % 3 AS c, event_id // 4 + user_id % 2 AS rp, user_id % 3 AS rc FROM events)
SELECT event_id, CASE WHEN p < rp OR (p = rp AND c < rc) THEN -1 WHEN p = rp AND c = rc THEN 0 ELSE 1 END AS cmp, p = rp AND c = rc AS concurrent,
  greatest((p << 16) | c, (rp << 16) | rc) AS latest, lpad(hex(p), 16, '0') || lpad(hex(c), 4, '0') AS marshalled, c = 65535 AS at_max FROM e""")
def hlc_compare(spark, sf_dir):
    """Order of two hybrid timestamps, the later one, and the ten-byte form."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 3").alias("p"), (F.col("event_id") % 3).alias("c"), (F.expr("event_id div 4") + F.col("user_id") % 2).alias("rp"), (F.col("user_id") % 3).alias("rc"))
    own, other = (F.struct(F.col(a).alias("pt"), F.col(b).alias("c")) for a, b in (("p", "c"), ("rp", "rc")))
    late = F.greatest(own, other)
    return e.select(
        "event_id", codec.hlc_compare(own, other).alias("cmp"), (own == other).alias("concurrent"), codec.hlc_pack(late["pt"], late["c"]).alias("latest"),
        F.hex(F.concat(codec.be(F.col("p"), 8), codec.be(F.col("c"), 2))).alias("marshalled"), (F.col("c") == 65535).alias("at_max"),
    )
