"""Transactions over a change log: net effects, commit and rollback, replay, undo, conflicts, watermarks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from .versions import existed, newest, with_previous


def net_ops(log: DataFrame) -> DataFrame:
    """What each (transaction, key) comes to: insert, update or delete with the last value.

    A delete of a key that did not exist before the transaction cancels and leaves no row.
    """
    first_last = with_previous(log).groupBy("tx_id", "key").agg(F.min_by("prev_deleted", "ts").alias("before"), F.max_by(F.struct("is_deleted", "value"), "ts").alias("last"))
    had = existed(F.col("before"))
    op = F.when(F.col("last.is_deleted"), F.when(had, "delete")).otherwise(F.when(had, "update").otherwise("insert"))
    return first_last.select("tx_id", "key", op.alias("net_op"), "last.value").where("net_op is not null")


def outcomes(log: DataFrame) -> DataFrame:
    """``tx_id, status, n_ops, commit_ts`` by each transaction's last entry."""
    return log.groupBy("tx_id").agg(F.max_by("status", "ts").alias("status"), F.count("*").alias("n_ops"), F.max("ts").alias("commit_ts"))


def replay(log: DataFrame, start: int) -> DataFrame:
    """The state after replaying entries from ``start`` over the state before it.

    Only committed transactions count, the first entry for each (transaction, key) applies, and an entry is skipped if
    the key already has a version as new as its commit.
    """
    base = newest(log.where(F.col("ts") < start)).select("key", "value", "ts", "is_deleted")
    done = outcomes(log.where(F.col("ts") >= start)).where("status = 'commit'").select("tx_id", "commit_ts")
    redo = log.where(F.col("ts") >= start).groupBy("tx_id", "key").agg(F.min_by(F.struct("value", "is_deleted"), "ts").alias("v"))
    redo = redo.join(done, "tx_id").select("key", "v.value", F.col("commit_ts").alias("ts"), "v.is_deleted")
    return newest(base.unionByName(redo)).where("not is_deleted").select("key", "value", "ts")


def undo(log: DataFrame, status: str = "open") -> DataFrame:
    """Old values that prepared but uncommitted transactions give back: ``tx_id, key, restored_value, restored_deleted``."""
    old = F.min_by(F.struct("prev_deleted", "prev_value"), "ts").alias("o")
    out = with_previous(log).where(F.col("status") == status).groupBy("tx_id", "key").agg(old)
    return out.select("tx_id", "key", F.when(existed(F.col("o.prev_deleted")), F.col("o.prev_value")).alias("restored_value"), (~existed(F.col("o.prev_deleted"))).alias("restored_deleted"))


def prepare_entries(log: DataFrame) -> DataFrame:
    """``tx_id, value``: the prepare entry of each transaction, a record for each key that it changes, in byte order of the keys.

    Keys are written as text, values as ``v`` and the timestamp of their version. A record has what undo needs: the flag, timestamp and
    value before. A delete of a key that did not exist leaves no record. One entry holds one write set, as the log has it.
    """
    w = Window.partitionBy("key").orderBy("ts")
    linked = log.select("tx_id", "key", "ts", "is_deleted", F.lag("ts").over(w).alias("old_ts"), F.lag("is_deleted").over(w).alias("old_deleted"))
    per = linked.groupBy("tx_id", "key").agg(F.min_by(F.struct("old_ts", "old_deleted"), "ts").alias("o"), F.max("ts").alias("ts"), F.max_by("is_deleted", "ts").alias("gone"))
    had = existed(F.col("o.old_deleted"))
    op = F.when(F.col("gone"), F.when(had, 2)).when(had, 1).otherwise(0)
    text = lambda c: F.concat(F.lit("v"), F.col(c).cast("string")).cast("binary")
    nothing = F.lit(b"")
    old_flag = F.when(F.col("o.old_deleted"), codec.TOMBSTONE).otherwise(codec.NORMAL)
    rows = per.withColumn("op", op).where("op is not null").withColumn("k", F.col("key").cast("string").cast("binary"))
    record = codec.prepare_record(F.col("k"), F.col("op"), old_flag, F.coalesce("o.old_ts", F.lit(0)), F.when(had, text("o.old_ts")).otherwise(nothing), F.when(F.col("op") == 2, nothing).otherwise(text("ts")))
    body = rows.select("tx_id", "k", record.alias("record")).groupBy("tx_id").agg(F.count("*").alias("n"), F.expr("listagg(record) within group (order by k)").alias("body"))
    return body.select("tx_id", F.concat(codec.be(F.col("n"), 4), "body").alias("value"))


def conflicts(intervals: DataFrame, width: int) -> DataFrame:
    """Pairs of transactions with overlapping [low, high] on one key: ``key, tx_a, tx_b`` with tx_a < tx_b.

    A range join: each interval is dealt to the time buckets that it covers, so only neighbours meet.
    """
    dealt = intervals.withColumn("__b", F.explode(F.expr(f"sequence(low div {width}, high div {width})")))
    a = dealt.select("key", "__b", F.col("tx_id").alias("tx_a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    b = dealt.select("key", "__b", F.col("tx_id").alias("tx_b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    return a.join(b, ["key", "__b"]).where("tx_a < tx_b and la <= hb and lb <= ha").select("key", "tx_a", "tx_b").distinct()


def numbered_links(log: DataFrame, order: str = "lsn") -> DataFrame:
    """``log`` with ``prev_lsn``: the transaction's entry before."""
    return log.withColumn("prev_lsn", F.lag(order).over(Window.partitionBy("tx_id").orderBy(order)))


class Conflict(ValueError):
    """A key was committed by another writer after the transaction's snapshot."""


class Session:
    """A transaction over a change-log folder: buffered writes, reads, an atomic append on commit.

    A ``snapshot`` session reads the state at its begin, and the first of two that write a key wins. A ``read_committed``
    session reads the newest commit each time, and does not conflict.
    """

    def __init__(self, store: Store, snapshot: int, isolation: str = "snapshot"):
        if isolation not in ("snapshot", "read_committed"):
            raise ValueError(f"unknown isolation {isolation}")
        self.store, self.snapshot, self.isolation, self.rows, self.state = store, snapshot, isolation, [], "active"

    def _check(self):
        if self.state != "active":
            raise ValueError(f"transaction is {self.state}")

    def put(self, key: int, value: float) -> None:
        self._check()
        self.rows.append((key, value, False))

    def delete(self, key: int) -> None:
        """Buffers a tombstone; a key that is not visible is an error."""
        if self.view().where(F.col("key") == key).isEmpty():
            raise KeyError(key)
        self.rows.append((key, None, True))

    def view(self) -> DataFrame:
        """What the session reads, under its own writes: ``key, value``."""
        from .versions import as_of, overlay

        self._check()
        own = {k: (k, v, d) for k, v, d in self.rows}
        changes = self.store.spark.createDataFrame(list(own.values()), "key bigint, value double, is_deleted boolean")
        at = self.snapshot if self.isolation == "snapshot" else max(self.store.commits(), default=0)
        return overlay(as_of(self.store.log(), at), changes).where("not is_deleted").select("key", "value")

    def commit(self) -> int:
        self._check()
        ts = self.store.append(self.rows, self.snapshot if self.isolation == "snapshot" else None)
        self.state = "committed"
        return ts

    def rollback(self) -> None:
        self._check()
        self.rows, self.state = [], "rolled back"


class Store:
    """A versioned key-value table: a folder with one subfolder of Parquet for each commit.

    Readers list commits by their success marker, so a half-written commit is never seen. A writer claims its timestamp by
    creating a file, which one of several writers can do, and checks conflicts once all earlier claims have ended.
    """

    SCHEMA = "key bigint, ts bigint, is_deleted boolean, value double"

    def __init__(self, spark, path: str, patience: float = 600.0):
        self.spark, self.path, self.patience = spark, path.rstrip("/"), patience

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, pattern: str) -> list[str]:
        p, fs = self._at(pattern)
        return [x.getPath().toString() for x in (fs.globStatus(p) or [])]

    def commits(self) -> list[int]:
        return sorted(int(x.split("commit=")[1].split("/")[0]) for x in self._names("commit=*/_SUCCESS"))

    def log(self, after: int = 0) -> DataFrame:
        """All committed versions, or those after a timestamp."""
        paths = [f"{self.path}/commit={n}" for n in self.commits() if n > after]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _claim(self) -> int:
        while True:
            ts = max([*self.commits(), *(int(x.rpartition("claim=")[2]) for x in self._names("_claims/claim=*"))], default=0) + 1
            p, fs = self._at(f"_claims/claim={ts}")
            fs.mkdirs(p.getParent())
            try:
                fs.create(p, False).close()  # fails if another writer has it
                return ts
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise

    def _settle(self, ts: int) -> None:
        """Wait until each earlier claim is committed or given up."""
        until = time.monotonic() + self.patience
        while True:
            ended = set(self.commits()) | {int(x.rpartition("over=")[2]) for x in self._names("_claims/over=*")}
            if not [n for x in self._names("_claims/claim=*") if (n := int(x.rpartition("claim=")[2])) < ts and n not in ended]:
                return
            if time.monotonic() > until:
                raise TimeoutError(f"an earlier writer of {self.path} has not ended")
            time.sleep(0.2)

    def write(self, changes: DataFrame, snapshot: int | None = None) -> int:
        """Commit ``key, value, is_deleted`` rows (batch upserts and deletes) and return the timestamp.

        Of rows that repeat a key, the one with the greatest ``seq`` counts, if there is such a column; else any. With ``snapshot``,
        a key that was committed after it raises ``Conflict`` and nothing is written. No rows: an empty commit.
        """
        order = F.col("seq") if "seq" in changes.columns else F.lit(0)
        kind = {"key": "bigint", "value": "double", "is_deleted": "boolean"}
        rows = changes.select(*(F.col(c).cast(k).alias(c) for c, k in kind.items()), order.alias("__seq")).where("key is not null")
        rows = rows.groupBy("key").agg(F.max_by("value", "__seq").alias("value"), F.max_by("is_deleted", "__seq").alias("is_deleted"))
        ts = self._claim()
        try:
            if snapshot is not None:
                self._settle(ts)
                taken = rows.join(self.log(after=snapshot).select("key").distinct(), "key", "left_semi").select("key").head(1)
                if taken:
                    raise Conflict(f"key {taken[0]['key']} was committed after {snapshot}")
            rows.select("key", F.lit(ts).cast("bigint").alias("ts"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "value").write.parquet(f"{self.path}/commit={ts}")
        except BaseException:
            p, fs = self._at(f"_claims/over={ts}")
            fs.create(p, True).close()
            raise
        return ts

    def append(self, rows: list[tuple], snapshot: int | None = None) -> int:
        """``write`` of (key, value, is_deleted) tuples; the last write of a key wins."""
        last = {k: (k, v, d) for k, v, d in rows}
        return self.write(self.spark.createDataFrame(list(last.values()), "key bigint, value double, is_deleted boolean"), snapshot)

    def begin(self, isolation: str = "snapshot") -> Session:
        return Session(self, max(self.commits(), default=0), isolation)

    def get(self) -> DataFrame:
        from .versions import live

        return live(self.log())
