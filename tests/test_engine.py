"""Behaviours of the store, its transactions and its codecs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import clocks, compaction, metrics, sequences, transactions, versions
from tidemark.sources import binary

LOG = "key bigint, ts bigint, is_deleted boolean, value double"


def state(df):
    return {r.key: r.value for r in df.collect()}


def test_store_lifecycle(spark, tmp_path):
    store = transactions.Store(spark, str(tmp_path / "kv"))
    assert state(store.get()) == {}
    one = store.begin()
    two = store.begin()
    two.put(1, 1.0)
    two.commit()
    assert state(one.view()) == {}  # isolated from the later commit
    one.put(2, 5.0)
    assert state(one.view()) == {2: 5.0}  # reads its own writes
    one.rollback()
    with pytest.raises(ValueError):
        one.put(3, 1.0)
    assert state(store.get()) == {1: 1.0}
    three = store.begin()
    three.put(1, 2.0)
    three.put(1, 3.0)
    three.commit()
    assert state(store.get()) == {1: 3.0}  # last write wins
    four = store.begin()
    four.delete(1)
    assert state(four.view()) == {}
    four.commit()
    assert state(store.get()) == {}
    five = store.begin()
    five.put(1, 9.0)
    five.commit()
    assert state(store.get()) == {1: 9.0}
    assert state(versions.as_of(store.log(), 2)) == {1: 3.0}


def test_store_conflicts_and_isolation(spark, tmp_path):
    store = transactions.Store(spark, str(tmp_path / "kv"), patience=1.0)
    frame = lambda *rows: spark.createDataFrame(list(rows), "key bigint, value double, is_deleted boolean, seq bigint")
    assert store.write(frame((1, 1.0, False, 1), (1, 2.0, False, 3), (1, None, True, 2), (2, 5.0, False, 1), (3, 7.0, None, 1))) == 1
    assert state(store.get()) == {1: 2.0, 2: 5.0, 3: 7.0}
    a, b, c = store.begin(), store.begin(), store.begin("read_committed")
    a.put(1, 10.0)
    b.put(1, 11.0)
    b.put(4, 1.0)
    c.put(1, 12.0)
    a.commit()
    assert state(b.view()) == {1: 11.0, 2: 5.0, 3: 7.0, 4: 1.0} and state(c.view())[1] == 12.0
    assert state(store.begin("read_committed").view())[1] == 10.0
    with pytest.raises(transactions.Conflict):
        b.commit()
    assert state(store.get()) == {1: 10.0, 2: 5.0, 3: 7.0}  # nothing of it is seen
    c.commit()
    assert state(store.get())[1] == 12.0
    with pytest.raises(KeyError):
        store.begin().delete(99)
    with pytest.raises(ValueError):
        store.begin("chaos")
    store.write(frame().limit(0))
    assert state(store.get()) == {1: 12.0, 2: 5.0, 3: 7.0}
    assert len({store._claim() for _ in range(3)}) == 3
    with pytest.raises(TimeoutError):  # the claims above never end
        store.write(frame((2, 1.0, False, 1)), snapshot=max(store.commits()))


def test_inline_versions(spark):
    log = spark.createDataFrame([(1, 1, False, 1.0), (1, 2, False, 2.0), (2, 1, False, 1.0), (2, 2, True, None), (2, 3, False, 3.0), (3, 1, False, 1.0), (3, 2, False, 2.0), (3, 3, False, 3.0)], LOG)
    assert state(versions.as_of(log, 1, "inline2")) == {1: 1.0}  # 2: cut by the insert; 3: older than both
    assert state(versions.as_of(log, 1)) == {1: 1.0, 2: 1.0, 3: 1.0}


def test_lookup_keeps_order_and_empties(spark):
    keys = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "ordinal bigint, key bigint")
    got = versions.lookup(keys, spark.createDataFrame([(7, b"")], "key bigint, value binary")).orderBy("ordinal").collect()
    assert [None if r.value is None else bytes(r.value) for r in got] == [b"", b"", None]


def test_net_ops_cancel(spark):
    log = spark.createDataFrame([(1, 1, False, 1.0, 1), (1, 2, True, None, 1), (2, 1, False, 1.0, 0), (2, 3, True, None, 1), (2, 4, False, 4.0, 1)], LOG + ", tx_id bigint")
    got = {(r.tx_id, r.key): (r.net_op, r.value) for r in transactions.net_ops(log).collect()}
    assert got == {(0, 2): ("insert", 1.0), (1, 2): ("update", 4.0)}


def test_compaction_keeps_tombstones_at_the_watermark(spark):
    s = spark.createDataFrame([(0, 5, True), (0, 9, True), (0, 10, True), (0, 11, False)], "page bigint, ts bigint, is_deleted boolean")
    r = compaction.tombstone_pages(s, 10).first()
    assert (r.droppable, r.compacted, r.survivors) == (2, False, 4)


def test_sequences_match_a_global_window(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k bigint, v bigint")
    got = {r.k: r.s for r in sequences.running(df, "k", F.col("v"), "s", 10).collect()}
    total, want = 0, {}
    for k, v in sorted((i * 7 % 101, i) for i in range(101)):
        total += v
        want[k] = total
    assert got == want
    assert {r.k: r.s for r in sequences.running(df, "k", F.col("v"), "s").collect()} == want
    deep = sequences.running(df, "k", F.col("v"), "s", 1, ranges=3)  # ranges of ranges
    assert {r.k: r.s for r in deep.collect()} == want
    assert sequences.numbered(df.limit(0), "k", "n").collect() == []


def test_version_codec(spark):
    df = spark.createDataFrame([(2**62, b"hello", b""), (42, b"", b"old")], "ts bigint, v binary, p binary")
    b = codec.build_version(F.lit(0), F.col("ts"), F.col("v"), F.lit(1), F.col("ts") - 1, F.col("p"))
    for r in df.select("*", codec.parse_version(b).alias("x")).collect():
        assert (int(r.x.ts), bytes(r.x.value), bytes(r.x.prev_value), int(r.x.prev_ts)) == (r.ts, bytes(r.v), bytes(r.p), r.ts - 1)
    assert spark.range(1).select(codec.parse_version(F.lit(b"short")).alias("x")).first().x is None


def test_framing():
    assert binary.crc32c(b"123456789") == 0xE3069283
    f = binary.frame(1, 42, 2, b"key", b"")
    assert len(f) % 8 == 0 and binary.unframe(f) == (1, 42, 2, b"key", b"")
    assert binary.unframe(f[:-1]) is None and binary.unframe(f[:8] + b"\x01" + f[9:]) is None
    entries = [(i, i // 3, 0, b"k" * (i % 5), b"v" * (i * 7 % 40)) for i in range(30)]
    whole = binary.frames(entries)
    assert binary.scan(b"".join(whole)) == entries
    bad = [f[:27] + b"\xff" + f[28:] if i % 4 == 1 else f for i, f in enumerate(whole)]
    assert [e[0] for e in binary.scan(b"".join(bad)[:-3])] == [i for i in range(29) if i % 4 != 1]
    assert binary.crc32c_many([b"", b"123456789", b"a"]).tolist() == [0, 0xE3069283, 0xC1D04330]
    with pytest.raises(ValueError):
        binary.expand("zstd", __import__("zstandard").compress(bytes(100)), 99)
    x = {"a": [1, -5, None, True, b"\x00", "é"], "b": {}}
    assert binary.unpack(binary.pack(x))[0] == x


def test_clock_stamps_match_a_fold(spark):
    times = [0, 0, 1, 5, 5, 4, 2, 5, 6, 6, 3, 9] + [9] * 70_000 + [10, 10, 12]
    df = spark.createDataFrame([(7, i, t) for i, t in enumerate(times)], "node bigint, i bigint, t bigint")
    last, want = (1 << 16) | 65530, []
    for t in times:
        pt, c = last >> 16, last & 65535
        last = t << 16 if t > pt else (pt + 1) << 16 if c == 65535 else last + 1
        want.append(last)
    got = clocks.now(df, "node", "i", F.col("t"), (1 << 16) | 65530)
    assert [r.packed for r in got.orderBy("i").collect()] == want
    assert got.columns == ["node", "i", "t", "packed"]


def test_prepare_entries(spark):
    log = spark.createDataFrame([(10, 1, False, 1.0, 0), (10, 5, True, None, 1), (9, 6, False, 2.0, 1), (9, 7, False, 3.0, 1), (8, 8, True, None, 1)], LOG + ", tx_id bigint")
    got = {r.tx_id: bytes(r.value) for r in transactions.prepare_entries(log).collect()}
    assert binary.prepared(got[0]) == [(b"10", 0, 0, 0, b"", 0, b"v1")]
    assert binary.prepared(got[1]) == [(b"10", 2, 0, 1, b"v1", 1, b""), (b"9", 0, 0, 0, b"", 0, b"v7")]  # 8 did not exist
    assert all(binary.prepared(got[1][:n]) is None for n in range(len(got[1]))) and binary.prepared(got[1] + b"x") is None
    assert transactions.prepare_entries(log.limit(0)).collect() == []


def test_request_getters(spark):
    rows = [("n-1-7fffffffffffffff-ffffffff", "n-1", 2**63 - 1, 2**32 - 1), ("n-1-8000000000000000-100000000", "n-1", 0, 0), ("a-1f-2", "a", 31, 0), ("--", "", 0, 0), ("x", "", 0, 0), ("", "", 0, 0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "rid string")
    assert [tuple(r) for r in df.select(*codec.request_getters(F.col("rid"))).collect()] == [r[1:] for r in rows]


def test_quorum_rules(spark):
    df = spark.createDataFrame([(1, True, 3), (1, True, 1), (1, False, 2), (2, False, 1)], "task_id bigint, ok boolean, at int")
    got = {r.task_id: (r.majority_ok, r.all_ok, r.majority_at) for r in metrics.quorum(df).collect()}
    assert got == {1: (True, False, 3), 2: (False, False, None)}
