"""Lookups, snapshots, transactions and recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import sequences, transactions, versions
from ..sources.changelog import change_log, table
from ..streaming import ingest
from .registry import LINKED, LOG, RANKED, query

#: Sample snapshot and watermark.
W = 5000


@query(RANKED + " SELECT key, value, ts FROM r WHERE r = 1 AND NOT del")
def latest_by_key(spark, sf_dir):
    """Get for all keys: the newest live value."""
    return versions.live(change_log(spark, sf_dir))


@query(RANKED + " SELECT key, value, ts, del AS is_deleted FROM r WHERE r = 1")
def latest_raw(spark, sf_dir):
    """Raw get: tombstones included."""
    return versions.newest(change_log(spark, sf_dir))


@query(RANKED + " SELECT key, value FROM r WHERE r = 1 AND NOT del")
def store_batches(spark, sf_dir):
    """Batch upserts and deletes committed to a store, four commits of the log in turn, and read back."""
    log = change_log(spark, sf_dir)
    store = transactions.Store(spark, ingest.folder(spark, "store"))
    for low in range(0, 4):
        part = F.least(F.expr("ts div 2000"), F.lit(3)) == low
        store.write(log.where(part).select("key", "value", "is_deleted", F.col("ts").alias("seq")), snapshot=low)
    return store.get().select("key", "value")


@query(RANKED + " SELECT count(*) AS live_keys FROM r WHERE r = 1 AND NOT del")
def live_size(spark, sf_dir):
    return versions.newest(change_log(spark, sf_dir)).agg(F.count_if(~F.col("is_deleted")).alias("live_keys"))


@query(RANKED.replace("FROM l)", f"FROM l WHERE ts <= {W})") + " SELECT key, value, ts FROM r WHERE r = 1 AND NOT del")
def as_of_full(spark, sf_dir):
    return versions.as_of(change_log(spark, sf_dir), W)


@query(RANKED + """, w AS (SELECT max(ts) - 100 AS w FROM l), two AS (SELECT a.key, a.ts AS t1, a.value AS v1, a.del AS d1, b.ts AS t2, b.value AS v2, b.del AS d2
  FROM r a LEFT JOIN r b ON a.key = b.key AND b.r = 2 WHERE a.r = 1)
SELECT key, CASE WHEN t1 <= w THEN v1 ELSE v2 END AS value, CASE WHEN t1 <= w THEN t1 ELSE t2 END AS ts
FROM two, w WHERE (t1 <= w AND NOT d1) OR (t1 > w AND t2 <= w AND NOT d2)""")
def as_of_inline2(spark, sf_dir):
    """A snapshot a hundred entries old under the two-version rule."""
    log = change_log(spark, sf_dir)
    return versions.as_of(log, log.agg(F.max("ts")).first()[0] - 100, mode="inline2")


@query(LINKED + """ SELECT key, ts, value, CASE WHEN NOT prev_del THEN prev_ts END AS prev_ts, CASE WHEN NOT prev_del THEN prev_value END AS prev_value FROM p""")
def prev_version(spark, sf_dir):
    """Version shift: the previous version kept inline; none after an insert."""
    v, had = versions.with_previous(change_log(spark, sf_dir)), versions.existed(F.col("prev_deleted"))
    return v.select("key", "ts", "value", F.when(had, F.col("prev_ts")).alias("prev_ts"), F.when(had, F.col("prev_value")).alias("prev_value"))


@query(RANKED + """ SELECT c_custkey AS ordinal, c_custkey % 200 AS key, s.value FROM customer
LEFT JOIN (SELECT key, value FROM r WHERE r = 1 AND NOT del) s ON s.key = c_custkey % 200""")
def get_batch(spark, sf_dir):
    """Batch get: one row for each requested position, repeated keys repeated, missing keys null."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") % 200).alias("key"))
    return versions.lookup(keys, versions.live(change_log(spark, sf_dir))).select("ordinal", "key", "value")


@query(LOG + f""", s AS (SELECT key, value, del, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM l WHERE ts <= {W}),
b AS (SELECT key, value, del, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM l WHERE ts > {W} AND ts <= {W + 500})
SELECT coalesce(s.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.value ELSE s.value END AS value, b.key IS NOT NULL AS changed
FROM (SELECT * FROM s WHERE r = 1 AND NOT del) s FULL JOIN (SELECT * FROM b WHERE r = 1) b ON s.key = b.key WHERE NOT coalesce(b.del, false)""")
def get_batch_own_writes(spark, sf_dir):
    """A snapshot under a transaction's own writes."""
    log = change_log(spark, sf_dir)
    buffer = versions.newest(log.where(F.col("ts").between(W + 1, W + 500)))
    return versions.overlay(versions.as_of(log, W), buffer).where("not is_deleted").select("key", "value", "changed")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000 ORDER BY key")
def range_scan(spark, sf_dir):
    """Half-open ordered range scan; bounds reach the Parquet reader."""
    rows = table(spark, sf_dir, "orders").where("o_orderkey >= 1000 and o_orderkey < 2000")
    return rows.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")).orderBy("key")


@query(LOG + """, b AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM l WHERE ts % 3 = 0 AND NOT del),
s AS (SELECT key, value, del, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM l WHERE ts % 3 <> 0)
SELECT coalesce(s.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.value ELSE s.value END AS value
FROM (SELECT * FROM s WHERE r = 1 AND NOT del) s FULL JOIN (SELECT * FROM b WHERE r = 1) b ON s.key = b.key""")
def set_batch_lww(spark, sf_dir):
    """Batch upsert: the last write of a key in the batch wins over the base."""
    log = change_log(spark, sf_dir)
    batch = versions.newest(log.where("ts % 3 = 0 and not is_deleted"))
    return versions.overlay(versions.live(log.where("ts % 3 <> 0")), batch).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def delete_batch(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")).join(gone, "key", "left_anti")


@query("SELECT count(*) FILTER (WHERE NOT k > p) AS violations FROM (SELECT o_orderkey AS k, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL")
def key_order_check(spark, sf_dir):
    """Keys in order that are not above the one before: in sorted order, those are the repeats."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("violations"))


@query("""SELECT CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(c_name) + 1), lambda i: CAST(ord(substr(c_name, i, 1)) AS BIGINT))),
  lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 64 AS BIGINT) AS shard, count(*) AS n FROM customer GROUP BY 1""")
def shard_histogram(spark, sf_dir):
    """Keys over 64 write shards by FNV-1a."""
    return table(spark, sf_dir, "customer").groupBy((codec.fnv1a32(F.col("c_name")) % 64).alias("shard")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 700 = 0), k AS (SELECT c_custkey * 7 AS key FROM customer)
SELECT key, count(s.k) AS page FROM k LEFT JOIN s ON s.k <= k.key GROUP BY key""")
def page_of_key(spark, sf_dir):
    """The page of a key: separators at or below it."""
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("key"))
    marks = table(spark, sf_dir, "orders").where("o_orderkey % 700 = 0").select(F.col("o_orderkey").alias("key"))
    return sequences.separators_up_to(keys, "key", marks, "page")


@query(LINKED + """, f AS (SELECT tx_id, key, arg_min(coalesce(NOT prev_del, false), ts) AS had FROM p GROUP BY ALL),
e AS (SELECT tx_id, key, del, value FROM (SELECT *, row_number() OVER (PARTITION BY tx_id, key ORDER BY ts DESC) r FROM l) WHERE r = 1)
SELECT tx_id, key, CASE WHEN del THEN 'delete' WHEN had THEN 'update' ELSE 'insert' END AS net_op, value FROM f JOIN e USING (tx_id, key) WHERE had OR NOT del""")
def net_ops(spark, sf_dir):
    return transactions.net_ops(change_log(spark, sf_dir))


@query(LOG + " SELECT tx_id, count(*) AS n_ops, max(ts) AS commit_ts FROM l GROUP BY tx_id HAVING arg_max(status, ts) = 'commit'")
def committed_tx(spark, sf_dir):
    return transactions.outcomes(change_log(spark, sf_dir)).where("status = 'commit'").select("tx_id", "n_ops", "commit_ts")


@query(LOG + """, base AS (SELECT key, value, ts, del FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM l WHERE ts < 1000) WHERE r = 1),
c AS (SELECT tx_id, max(ts) AS cts FROM l WHERE ts >= 1000 GROUP BY tx_id HAVING arg_max(status, ts) = 'commit'),
redo AS (SELECT key, value, cts AS ts, del FROM (SELECT *, row_number() OVER (PARTITION BY tx_id, key ORDER BY ts) r FROM l WHERE ts >= 1000) JOIN c USING (tx_id) WHERE r = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) r FROM (SELECT * FROM base UNION ALL SELECT * FROM redo))
SELECT key, value, ts FROM a WHERE r = 1 AND NOT del""")
def replay_state(spark, sf_dir):
    return transactions.replay(change_log(spark, sf_dir), 1000)


@query(LINKED + """, f AS (SELECT *, row_number() OVER (PARTITION BY tx_id, key ORDER BY ts) r FROM p WHERE status = 'open')
SELECT tx_id, key, CASE WHEN NOT prev_del THEN prev_value END AS restored_value, coalesce(prev_del, true) AS restored_deleted FROM f WHERE r = 1""")
def undo_2pc(spark, sf_dir):
    return transactions.undo(change_log(spark, sf_dir))


@query(LOG + ", n AS (SELECT ts, tx_id, row_number() OVER (ORDER BY ts) AS lsn FROM l) SELECT ts, lsn, lag(lsn) OVER (PARTITION BY tx_id ORDER BY lsn) AS prev_lsn FROM n")
def ts_sequence(spark, sf_dir):
    """Log sequence numbers in arrival order, and each entry's predecessor in its transaction."""
    n = sequences.numbered(change_log(spark, sf_dir).select("ts", "tx_id"), "ts", "lsn")
    return transactions.numbered_links(n).select("ts", "lsn", "prev_lsn")


@query("""WITH i AS (SELECT user_id AS key, (event_id // 80) * 4 + event_id % 4 AS tx_id, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY ALL)
SELECT a.key, a.tx_id AS tx_a, b.tx_id AS tx_b FROM i a JOIN i b ON a.key = b.key AND a.tx_id < b.tx_id AND a.low <= b.high AND b.low <= a.high""")
def conflicts(spark, sf_dir):
    """Interleaved transactions that hold one key at overlapping times."""
    tx = F.expr("(event_id div 80) * 4 + event_id % 4")
    spans = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), tx.alias("tx_id")).agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return transactions.conflicts(spans, 80)


@query(LOG + """ SELECT key % 8 AS node, max(ts) AS node_watermark, (SELECT coalesce(min(CASE WHEN status = 'open' THEN ts END), max(ts)) FROM l) AS watermark FROM l GROUP BY 1""")
def gc_watermark(spark, sf_dir):
    """The collection horizon (oldest open snapshot, else the newest timestamp) and the newest of each node."""
    nodes = change_log(spark, sf_dir).groupBy((F.col("key") % 8).alias("node")).agg(F.max("ts").alias("node_watermark"), F.min(F.when(F.col("status") == "open", F.col("ts"))).alias("oldest"))
    whole = Window.partitionBy(F.lit(1))  # one row a node
    return nodes.select("node", "node_watermark", F.coalesce(F.min("oldest").over(whole), F.max("node_watermark").over(whole)).alias("watermark"))


@query(RANKED + f", b AS (SELECT key, max(ts) AS m FROM l WHERE ts <= {W} GROUP BY key) SELECT r.key, r.ts FROM r LEFT JOIN b USING (key) WHERE r <= 3 OR ts = m")
def version_prune(spark, sf_dir):
    return versions.prune(change_log(spark, sf_dir), W, 3).select("key", "ts")


@query("""SELECT user_id AS key, min(value) AS low, max(value) AS high, arg_max(event_id, value + event_id * 1e-9) AS highest_at, max(event_id) AS last_ts,
  greatest(max(event_id), min(event_id) + 9000) AS horizon FROM events GROUP BY 1""")
def extremes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("event_id", F.col("value") + F.col("event_id") * F.lit(1e-9)).alias("highest_at"),
        F.max("event_id").alias("last_ts"), F.greatest(F.max("event_id"), F.min("event_id") + 9000).alias("horizon"),
    )


@query("SELECT event_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract_string(props, '$.missing') IS NULL THEN -1 END AS missing FROM events")
def ext_int(spark, sf_dir):
    """Typed getters on an extension map; a missing field falls back."""
    ext = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.try_element_at(ext, F.lit("k")).cast("bigint").alias("k"), F.coalesce(F.try_element_at(ext, F.lit("missing")).cast("int"), F.lit(-1)).alias("missing"))


@query("""SELECT chunk_id, n_read, n_dead, n_kept, n_both FROM (SELECT 1) JOIN (
SELECT l_orderkey // 1000 AS chunk_id, count(*) AS n_read, count(*) FILTER (WHERE l_returnflag = 'R') AS n_dead, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_kept, 0 AS n_both FROM lineitem GROUP BY 1) ON true""")
def live_union(spark, sf_dir):
    """Set operations: live pages are all pages except the removed; both parts give the whole again and share nothing."""
    all_pages = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 1000").alias("chunk_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    dead = all_pages.where("l_returnflag = 'R'")
    kept = all_pages.exceptAll(dead)
    count = lambda df, name: df.groupBy("chunk_id").agg(F.count("*").alias(name))
    out = count(kept.unionByName(dead), "n_read").join(count(dead, "n_dead"), "chunk_id").join(count(kept, "n_kept"), "chunk_id")
    both = count(kept.intersect(dead), "n_both")
    return out.join(both, "chunk_id", "left").select("chunk_id", "n_read", "n_dead", "n_kept", F.coalesce("n_both", F.lit(0)).cast("int").alias("n_both"))


@query("""WITH s AS (SELECT event_id // 1000 AS segment, event_id AS lsn FROM events), n AS (SELECT segment, lsn, row_number() OVER (ORDER BY segment, lsn) AS position FROM s)
SELECT segment, count(*) AS n, min(position) AS first_position, max(position) AS last_position, count(*) FILTER (WHERE lsn < position - 1) AS violations FROM n GROUP BY segment""")
def wal_scan_order(spark, sf_dir):
    """Segments scanned in name order; entries numbered across them."""
    n = sequences.numbered(table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("segment"), F.col("event_id").alias("lsn")), "lsn", "position", 1000)
    return n.groupBy("segment").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.count_if(F.col("lsn") < F.col("position") - 1).alias("violations"))


@query("""SELECT page % 16 AS core, CAST(sum(n) AS BIGINT) AS load FROM (SELECT l_suppkey AS page, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1""")
def routing_load(spark, sf_dir):
    """Loads of cores under abs(id) % cores routing."""
    return table(spark, sf_dir, "lineitem").groupBy((F.abs("l_suppkey") % 16).alias("core")).agg(F.count("*").alias("load"))


