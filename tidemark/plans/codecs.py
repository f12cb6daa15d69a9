"""Formats, identifiers, clocks, large objects, generators and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..sources import binary, generators
from ..sources.changelog import table
from ..streaming import ingest
from .registry import query


@query("""SELECT CAST(l_linenumber % 6 AS INT) AS flag, (l_linenumber % 6) & 1 = 1 AS is_tombstone, l_linenumber % 6 IN (2, 3) AS is_lob, l_linenumber % 6 IN (4, 5) AS is_lob_file, count(*) AS n FROM lineitem GROUP BY ALL""")
def tombstone_flags(spark, sf_dir):
    flag = (F.col("l_linenumber") % 6).cast("int")
    g = table(spark, sf_dir, "lineitem").groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))
    return g.select("flag", codec.is_tombstone(F.col("flag")).alias("is_tombstone"), F.col("flag").isin(codec.LOB, codec.LOB_TOMBSTONE).alias("is_lob"), F.col("flag").isin(codec.LOB_FILE, codec.LOB_FILE_TOMBSTONE).alias("is_lob_file"), "n")


@query("""WITH s AS (SELECT p_partkey AS key, 'm' || p_partkey % 5 || ':' || lower(p_brand) || ':s' || p_size % 7 AS source_id FROM part)
SELECT key, source_id, split_part(source_id, ':', 1) = 'm1' AND split_part(source_id, ':', 3) = 's3' AS matched FROM s""")
def wildcard_match(spark, sf_dir):
    sid = F.concat_ws(":", F.concat(F.lit("m"), F.col("p_partkey") % 5), F.lower("p_brand"), F.concat(F.lit("s"), F.col("p_size") % 7))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), sid.alias("source_id")).withColumn("matched", codec.source_matches(F.col("source_id"), "m1:*:s3"))


@query("""WITH e AS (SELECT event_id, user_id % 4 AS node, event_id // 3 AS pt FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY node, pt ORDER BY event_id) - 1 AS c FROM e)
SELECT event_id, node, pt, c, (pt << 16) | c AS packed FROM c""")
def hlc_fold(spark, sf_dir):
    """Hybrid timestamps of a node's events: the counter breaks ties of the physical part."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("node"), F.expr("event_id div 3").alias("pt"))
    c = (F.row_number().over(Window.partitionBy("node", "pt").orderBy("event_id")) - 1).cast("bigint")
    return e.withColumn("c", c).withColumn("packed", codec.hlc_pack(F.col("pt"), F.col("c")))


@query("""WITH e AS (SELECT event_id, event_id // 3 AS now, event_id // 4 AS pt, event_id % 5 AS c, user_id * 30 AS rpt, user_id % 7 AS rc FROM events)
SELECT event_id, greatest(now, pt, rpt) AS pt, CASE WHEN now = pt AND pt = rpt THEN greatest(c, rc) + 1 ELSE 0 END AS c,
 CASE WHEN greatest(now, pt, rpt) = pt AND pt = rpt THEN greatest(c, rc) + 1 WHEN greatest(now, pt, rpt) = pt THEN c + 1 WHEN greatest(now, pt, rpt) = rpt THEN rc + 1 ELSE 0 END AS c_standard FROM e""")
def hlc_merge(spark, sf_dir):
    """Clock updates from remote timestamps, by the tie-only rule and by the published rule."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 3").alias("now"), F.expr("event_id div 4").alias("p"), (F.col("event_id") % 5).alias("k"), (F.col("user_id") * 30).alias("rp"), (F.col("user_id") % 7).alias("rk"))
    args = [F.col(x) for x in ("now", "p", "k", "rp", "rk")]
    return e.select("event_id", codec.hlc_update(*args)["pt"].alias("pt"), codec.hlc_update(*args)["c"].alias("c"), codec.hlc_update_standard(*args)["c"].alias("c_standard"))


@query("""SELECT DISTINCT (l_orderkey << 38) | (l_partkey << 6) | (CAST(l_linenumber AS BIGINT) << 1) AS position, l_orderkey AS chunk, l_partkey AS "offset", CAST(l_linenumber AS BIGINT) AS kind FROM lineitem""")
def chunk_position(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(codec.chunk_position(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")).alias("position")).distinct()
    return p.select("position", codec.position_parts(F.col("position")).alias("x")).select("position", "x.chunk", "x.offset", F.col("x.kind").cast("bigint").alias("kind"))


@query("""SELECT event_id AS ts, '00' || '01' || lpad(hex(event_id), 16, '0') || lpad(hex(length('p' || user_id)), 4, '0') || hex('p' || user_id) || lpad(hex(event_id + 1), 16, '0') || hex('v' || event_id) AS encoded,
 'p' || user_id AS prev_value, 'v' || event_id AS value, event_id + 1 AS parsed_ts, event_id AS parsed_prev_ts FROM events""")
def mvcc_roundtrip(spark, sf_dir):
    """Versioned values encoded to bytes and parsed back."""
    e = table(spark, sf_dir, "events")
    text = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string")).cast("binary")
    b = codec.build_version(F.lit(codec.NORMAL), F.col("event_id") + 1, text("v", "event_id"), F.lit(codec.TOMBSTONE), F.col("event_id"), text("p", "user_id"))
    x = e.select(F.col("event_id").alias("ts"), b.alias("b")).withColumn("x", codec.parse_version(F.col("b")))
    return x.select("ts", F.hex("b").alias("encoded"), F.col("x.prev_value").cast("string").alias("prev_value"), F.col("x.value").cast("string").alias("value"), F.col("x.ts").cast("bigint").alias("parsed_ts"), F.col("x.prev_ts").cast("bigint").alias("parsed_prev_ts"))


@query("""WITH t AS (SELECT 2048 AS o, 262144 AS f UNION ALL SELECT 2048, 16384), d AS (SELECT strlen(text) AS n FROM documents)
SELECT CAST(f AS INT) AS file_threshold, CASE WHEN n > f THEN 'file' WHEN n > o THEN 'overflow' ELSE 'inline' END AS tier, count(*) AS n, CAST(sum(n) AS BIGINT) AS bytes FROM d, t GROUP BY 1, 2""")
def lob_tiers(spark, sf_dir):
    """Payloads and bytes of each storage tier, under two thresholds."""
    size = F.octet_length("text").cast("bigint")
    rows = table(spark, sf_dir, "documents").select(size.alias("n")).withColumn("file_threshold", F.explode(F.array(F.lit(262144), F.lit(16384))))
    return rows.groupBy("file_threshold", codec.tier(F.col("n"), 2048, F.col("file_threshold")).alias("tier")).agg(F.count("*").alias("n"), F.sum("n").alias("bytes"))


@query("SELECT doc_id AS lob_id, CAST(ceil(strlen(text) / 4024.0) AS INT) AS n_pieces, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def lob_chunks(spark, sf_dir):
    """Large values cut into page-sized pieces and put together again."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(codec.pieces(F.col("text").cast("binary"))).alias("i", "piece"))
    whole = codec.put_together(cut, F.col("doc_id").alias("lob_id"))
    return whole.select("lob_id", "n_pieces", F.octet_length("b").cast("bigint").alias("n_bytes"), F.md5("b").alias("digest"))


@query("""SELECT c_custkey AS key, CASE WHEN strlen(text) > 16384 THEN 'file' WHEN strlen(text) > 2048 THEN 'overflow' WHEN text IS NOT NULL THEN 'inline' END AS tier,
 CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest FROM customer LEFT JOIN documents ON doc_id = c_custkey""")
def lob_lookup(spark, sf_dir):
    """Batch get of values of any size: small ones lie in the row, large ones are joined by reference and put together."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("value"))
    stored = docs.withColumn("tier", codec.tier(F.octet_length("value"), 2048, 16384))
    rows = stored.select("key", "tier", F.when(F.col("tier") == "inline", F.col("value")).alias("value"))
    side = stored.where("tier <> 'inline'").select(F.col("key").alias("lob_id"), F.posexplode(codec.pieces(F.col("value"))).alias("i", "piece"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    got = keys.join(rows, "key", "left")
    wanted = side.join(got.where("tier <> 'inline'").select(F.col("key").alias("lob_id")).distinct(), "lob_id", "left_semi")
    whole = codec.put_together(wanted, F.col("lob_id")).select(F.col("lob_id").alias("key"), "b")
    out = got.join(whole, "key", "left").select("key", "tier", F.coalesce("value", "b").alias("b"))
    return out.select("key", "tier", F.octet_length("b").cast("bigint").alias("n_bytes"), F.md5("b").alias("digest"))


@query("SELECT event_id, (user_id << 32) | event_id AS encoded, event_id AS page, user_id AS version, event_id <> 4294967295 AS valid, event_id % 2 = 0 AS leaf FROM events")
def child_pointer(spark, sf_dir):
    """Page id and version packed in one number, and read back; a reference holds the page and whether it is a leaf."""
    e = table(spark, sf_dir, "events").select("event_id", codec.child_pointer(F.col("event_id"), F.col("user_id")).alias("encoded"), (F.col("event_id") % 2 == 0).alias("leaf"))
    page, version = codec.child_parts(F.col("encoded"))
    return e.select("event_id", "encoded", page.alias("page"), version.alias("version"), codec.valid_page(page).alias("valid"), "leaf")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN 'none' ELSE 'zstd' END AS compression, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def payload_compression(spark, sf_dir):
    """Payloads over 1 KB are sent compressed and named so; back, none may grow over the limit."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload"))
    back = binary.decompress(binary.compress(docs))
    return back.select(F.col("id").alias("doc_id"), "compression", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.md5("payload").alias("digest"))


@query("SELECT event_id AS page, event_id % 7 <> 3 AS valid FROM events WHERE props IS NOT NULL AND props <> ''")
def page_checksums(spark, sf_dir):
    """Pages behind their checksum; one flipped byte is found."""
    e = table(spark, sf_dir, "events").where("props is not null and props <> ''").select(F.col("event_id").alias("page"), F.col("props").cast("binary").alias("data"))
    stored = binary.seal_pages(e)
    flipped = F.concat(F.substring("sealed", 1, 4), F.unhex(F.lit("00")), F.expr("substring(sealed, 6)"))
    return binary.check_pages(stored.select("page", F.when(F.col("page") % 7 == 3, flipped).otherwise(F.col("sealed")).alias("sealed")))


@query("SELECT event_id AS lsn, event_id // 10 AS tx_id, user_id AS key, md5(props) AS digest FROM events WHERE event_id % 13 <> 5")
def wal_recovery(spark, sf_dir):
    """Log segments with broken entries: a scan goes on at the next whole entry, eight bytes at a time."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.expr("event_id div 10").alias("tx_id"), F.lit(0).alias("kind"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    framed = binary.encode_entries(e, keep_lsn=True)
    broken = F.concat(F.expr("substring(frame, 1, 27)"), F.unhex(F.lit("FF")), F.expr("substring(frame, 29)"))
    framed = framed.select("lsn", F.when(F.col("lsn") % 13 == 5, broken).otherwise(F.col("frame")).alias("frame"))
    segments = framed.groupBy(F.expr("lsn div 200").alias("segment")).agg(F.expr("listagg(frame) within group (order by lsn)").alias("data"))
    got = binary.scan_segments(segments.select("data"))
    return got.select("lsn", "tx_id", F.col("key").cast("string").cast("bigint").alias("key"), F.md5("value").alias("digest"))


@query("""SELECT event_id, 'node-' || user_id || '-' || lpad(lower(hex(1704067200 + event_id)), 8, '0') || '-' || lpad(lower(hex(event_id % 65536)), 4, '0') AS request_id,
 'node-' || user_id AS node, 1704067200 + event_id AS second, event_id % 65536 AS seq FROM events""")
def request_id(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", codec.request_id(F.concat(F.lit("node-"), F.col("user_id")), F.col("event_id") + 1704067200, F.col("event_id") % 65536).alias("request_id"))
    return e.select("event_id", "request_id", codec.request_parts(F.col("request_id")).alias("x")).select("event_id", "request_id", "x.node", "x.second", "x.seq")


@query("SELECT 'key-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, 'value-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS value, o_orderkey AS number FROM orders")
def bench_kv(spark, sf_dir):
    kv = table(spark, sf_dir, "orders").select(F.format_string("key-%010d", "o_orderkey").alias("key"), F.format_string("value-%010d", "o_orderkey").alias("value"))
    return kv.withColumn("number", F.substring("key", 5, 10).cast("bigint"))


@query("SELECT p_partkey AS id, p_size AS blocks, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS used_block FROM part")
def header_parse(spark, sf_dir):
    """Chunk headers stored twice: the second block is read where the first is lost."""
    text = F.concat_ws("\n", F.concat(F.lit("id:"), "p_partkey"), F.concat(F.lit("blockCount:"), "p_size"))
    two = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 != 0, text).alias("b0"), text.alias("b1"))
    h = two.select(codec.header_map(F.coalesce("b0", "b1")).alias("h"), F.when(F.col("b0").isNull(), 1).otherwise(0).alias("used_block"))
    return h.select(F.col("h")["id"].cast("bigint").alias("id"), F.col("h")["blockCount"].cast("int").alias("blocks"), "used_block")


@query("""SELECT event_id % 14 AS code, CASE event_id % 14 WHEN 0 THEN 'Insert' WHEN 1 THEN 'Update' WHEN 2 THEN 'Delete' WHEN 3 THEN 'Commit' ELSE 'Unknown' END AS label, count(*) AS n FROM events GROUP BY ALL""")
def enum_labels(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in enumerate(("Insert", "Update", "Delete", "Commit")) for x in pair))
    code = (F.col("event_id") % 14).cast("int")
    g = table(spark, sf_dir, "events").groupBy(code.alias("c")).agg(F.count("*").alias("n"))
    return g.select(F.col("c").cast("bigint").alias("code"), F.coalesce(F.try_element_at(names, F.col("c")), F.lit("Unknown")).alias("label"), "n")


@query("""WITH a AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'tcp:bad' ELSE '/ip4/10.0.0.' || s_suppkey % 250 || '/tcp/' || (4000 + s_suppkey) END AS address, s_name AS peer FROM supplier)
SELECT key, address, regexp_full_match(address, '/ip4/[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+/tcp/[0-9]+') AND length(peer) BETWEEN 1 AND 128 AS valid FROM a""")
def address_valid(spark, sf_dir):
    good = F.concat(F.lit("/ip4/10.0.0."), F.col("s_suppkey") % 250, F.lit("/tcp/"), F.col("s_suppkey") + 4000)
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "tcp:bad").otherwise(good).alias("address"), "s_name")
    return a.select("key", "address", (F.col("address").rlike(r"^/ip4/\d+\.\d+\.\d+\.\d+/tcp/\d+$") & F.length("s_name").between(1, 128)).alias("valid"))


@query("SELECT event_id, CAST(least(pow(2.0, greatest(event_id % 40 - 16, 0)), 1000.0) AS DOUBLE) AS wait_us FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codec.backoff_us(F.col("event_id") % 40).alias("wait_us"))


@query("SELECT user_id AS key, max(event_id) AS ts, count(*) AS versions FROM events GROUP BY 1")
def wal_codec(spark, sf_dir):
    """Log entries framed with padding, CRC-32C and a trailer, then read back and folded."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.expr("event_id div 10").alias("tx_id"), F.lit(0).alias("kind"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    back = binary.decode_entries(binary.encode_entries(e))
    return back.groupBy(F.col("key").cast("string").cast("bigint").alias("key")).agg(F.max("lsn").alias("ts"), F.count("*").alias("versions"))


@query("SELECT event_id AS id, event_type AS kind, props AS payload FROM events")
def message_codec(spark, sf_dir):
    """Messages packed to MessagePack behind a length prefix, and unpacked."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    return binary.unpack_messages(binary.pack_messages(e))


@query()
def generated_keys(spark, sf_dir):
    """Uniform, Zipf, sequential and hot-spot keys with values, from one seed."""
    return generators.all_kinds(spark, 10_000)


@query("""WITH r AS (SELECT user_id AS key, event_id AS ts, value, event_type = 'error' AS del, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events)
SELECT key, value, ts FROM r WHERE r = 1 AND NOT del""")
def stream_upsert(spark, sf_dir):
    """Latest values after streaming the log in batches, one of them delivered twice."""
    return ingest.replayed_upsert(spark, sf_dir)


@query("""WITH r AS (SELECT l_orderkey AS task_id, l_linestatus = 'F' AS ok FROM lineitem)
SELECT task_id, count(*) AS total, count(*) FILTER (WHERE ok) AS success FROM r GROUP BY task_id HAVING count(*) FILTER (WHERE ok) > 0""")
def stream_quorum(spark, sf_dir):
    """Broadcast progress kept as streaming state."""
    return ingest.quorum_progress(spark, sf_dir)
