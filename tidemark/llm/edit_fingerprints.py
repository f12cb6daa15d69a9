"""Document fingerprints: randomised edit embedding, consistent bit sampling, banding and verification.

All pairs of fingerprints that share a band of slots are verified on all slots. With one band more than a near pair has different
slots, every near pair shares one, so ``group_id`` loses no link.

A shared random walk turns a whole text into a string in which aligned parts stay aligned after edits; a
fingerprint holds its bytes at ``SLOTS`` sampled steps (hashed by a fixed permutation). The share of equal
slots is the likeness of two texts.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cgk import moves, records, sampled_walks
from .common import discard, materialize, resolve_components, small_batches, total_bytes

SLOTS = 128
SEED = 6
#: Likeness from which texts are near, and the bands that their slots are cut into.
LIKENESS, BANDS = 0.8, 18
#: Bands that one pass looks at, which bounds the disk; members of a bucket that a task compares at once; members up to which a bucket's pairs are listed.
PASS_BANDS, BLOCK, FEW = 7, 20_000, 32
#: Text held at once by a worker, and text aimed at in a partition of the id order.
HOLD_BYTES = 8 << 20
RANGE_BYTES = 16 << 20


class Fingerprinter:
    def __init__(self, slots: int = SLOTS, seed: int = SEED):
        self.slots, self.move, self.sample = slots, moves(seed), records(slots, seed)
        self.relabel = np.random.default_rng(seed + 1).permutation(256).astype(np.uint8)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """(texts, slots) bytes; equal texts have equal rows."""
        return self.relabel[sampled_walks(texts, self.move, self.sample, self.slots)]


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _held(batches, limit: int):
    rows, n = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.append(row)
            n += len(row[1])
            if n >= limit:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def fingerprint(docs: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (hex) of every row's whole text. Null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        make = Fingerprinter(slots, seed)
        for rows in _held(batches, HOLD_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([f.tobytes().hex() for f in make([r[1] for r in rows])])], ["doc_id", "fingerprint"])

    return _text_rows(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def _settled(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, and the shuffle files that the write needed are deleted."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _joined(comp: np.ndarray, prints: np.ndarray, differ: int):
    """Pairs of rows that link the components ``comp`` of one bucket to those of its near pairs: a forest, not all pairs.

    What a row reaches is compared with those left only, so a bucket of near copies costs its members, a loose one its pairs.
    """
    _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.argsort(-size[comp], kind="stable")
    left = np.ones(len(comp), bool)
    for seed in order:
        if not left[seed]:
            continue
        front = np.flatnonzero(comp == comp[seed]) if size[comp[seed]] > 1 else np.array([seed])
        left[front] = False
        while len(front):
            reached = []
            rest = np.flatnonzero(left)
            at = 0
            while at < len(front) and len(rest):
                some = front[at : at + max(1, 20_000 // len(rest))]
                at += len(some)
                near = _far(prints[some][:, None], prints[rest][None]) <= differ
                hit = near.any(axis=0)
                if hit.any():
                    yield some[near[:, hit].argmax(axis=0)], rest[hit]
                    more = np.flatnonzero(left & np.isin(comp, comp[rest[hit]]))
                    left[more] = False
                    reached.append(more)
                    rest = np.flatnonzero(left)
            front = np.concatenate(reached) if reached else []


def _near(bucket: np.ndarray, comp: np.ndarray, prints: np.ndarray, differ: int):
    """Pairs of rows of the sorted ``bucket`` that are near; in large buckets, as many as link what is near."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(first, len(bucket)))
    few = np.repeat(size <= FEW, size)
    for d in range(1, FEW):
        i = np.flatnonzero((bucket[:-d] == bucket[d:]) & few[:-d] & (comp[:-d] != comp[d:]))
        for at in range(0, len(i), 32_768):
            k = i[at : at + 32_768]
            k = k[_far(prints[k], prints[k + d]) <= differ]
            yield k, k + d
    for a, n in zip(first[size > FEW], size[size > FEW], strict=True):
        for i, j in _joined(comp[a : a + n], prints[a : a + n], differ):
            yield a + i, a + j


def _linker(differ: int, hold: int = 50_000):
    """For rows ``bucket, comp, print`` sorted by bucket: ``a, b``, links of components."""

    def links(bucket, comp, prints):
        pairs = [np.stack([comp[i], comp[j]], axis=1) for i, j in _near(bucket, comp, prints, differ) if len(i)]
        a, b = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0).T if pairs else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held, n, limit = [], 0, hold
        for b in batches:
            if not b.num_rows:
                continue
            prints = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), prints))
            n += b.num_rows
            if n >= limit:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
                if cut:
                    yield links(*(c[:cut] for c in cols))
                held, n = [tuple(c[cut:] for c in cols)], n - cut
                limit = max(hold, 2 * n)
        if held:
            yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _linked(members: DataFrame, nodes: DataFrame, differ: int) -> DataFrame:
    """``a, b``: links between the components ``comp`` of ``bucket, key, comp``."""
    small_batches(nodes.sparkSession)
    rows = members.join(nodes.select("key", "print"), "key").select("bucket", "comp", "print")
    return _settled(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linker(differ), "a bigint, b bigint").distinct(), "links")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """``bucket, key, comp`` of cells of a bucket's blocks, in which each two members of different components meet.

    Members of the bucket's largest component are in one cell for each block of the others, and don't meet each other.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket")
    of = per.agg(F.max_by("comp", "c").alias("top"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all")
    blocks = lambda c: F.ceil(c / block).cast("int")
    rows = members.join(of.select("bucket", "top", blocks(F.col("most")).alias("kt"), blocks(F.col("all") - F.col("most")).alias("ko")), "bucket")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.when(F.col("comp") == F.col("top"), F.col("kt")).otherwise(F.col("ko"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.xxhash64("bucket", F.lit(kind), i, j)
    others = F.transform(each("ko"), lambda i: cell(1, F.least("at", i), F.greatest("at", i)))
    own = F.concat(others, F.transform(each("kt"), lambda j: cell(2, F.col("at"), j)))
    top = F.transform(each("ko"), lambda i: cell(2, i, F.col("at")))
    return rows.select(F.explode(F.when(F.col("comp") == F.col("top"), top).otherwise(own)).alias("bucket"), "key", "comp")


def near_groups(prints: DataFrame, likeness: float = LIKENESS, bands: int = BANDS, exact: bool = True, block: int = BLOCK) -> DataFrame:
    """``prints`` (``doc_id``, ``fingerprint`` and others) with ``group_id``, of the texts linked by banding and verification.

    All fingerprints that share a band of slots are verified with each other, on all slots. With ``exact``, a near pair has fewer
    different slots than there are bands, so none is missed, whatever ``bands`` says; without, two that agree in just 0.8 of the
    slots share one of 18 bands with a chance of 0.98. Equal fingerprints are one node. Buckets of over ``block`` members are linked
    in parts first; then what is not one component meets in cells of two parts. No rows: no rows.
    """
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).select("fingerprint", "low", F.xxhash64("fingerprint").alias("key"), F.unhex("fingerprint").alias("print"))
    nodes = _settled(nodes, "prints")
    slots = nodes.agg(F.max(F.length("print"))).first()[0] or 1
    differ = slots - math.ceil(likeness * slots - 1e-9)
    bands = min(slots, differ + 1 if exact else bands)
    cut = [slots * b // bands for b in range(bands + 1)]
    links, large = [], []
    for at in range(0, bands, PASS_BANDS):
        parts = [F.xxhash64(F.lit(b), F.substring("print", cut[b] + 1, cut[b + 1] - cut[b])) for b in range(at, min(bands, at + PASS_BANDS))]
        flat = nodes.select("key", F.explode(F.array(*parts)).alias("bucket"))
        met = flat.join(flat.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "bucket")
        met = _settled(met.select("bucket", "key", "members"), "met")
        salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / block)).cast("int")
        links.append(_linked(met.select(F.when(F.col("members") > block, F.xxhash64("bucket", salt)).otherwise(F.col("bucket")).alias("bucket"), "key", F.col("key").alias("comp")), nodes, differ))
        large.append(_settled(met.where(F.col("members") > block), "large"))
        discard(met)
    links, large = (functools.reduce(DataFrame.unionByName, x) for x in (links, large))
    root = None if links.isEmpty() else materialize(resolve_components(links), "roots")
    if not large.isEmpty():
        comp = large if root is None else large.join(root, large.key == root.node, "left")
        members = _settled(comp.select("bucket", "key", (F.col("key") if root is None else F.coalesce("root", "key")).alias("comp")), "members")
        more = _linked(_cells(members, block), nodes, differ)
        if not more.isEmpty():
            root = materialize(resolve_components(links.unionByName(more)), "roots")
    known = nodes.select("fingerprint", "low", F.col("key").alias("root"))
    if root is not None:
        known = nodes.join(root, nodes.key == root.node, "left").select("fingerprint", "low", F.coalesce("root", "key").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("group_id"))
    return prints.join(known.join(least, "root").select("fingerprint", "group_id"), "fingerprint").select(*(c for c in prints.columns if c != "group_id"), "group_id")


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, a binary, b binary, near_edited double, near_next double"
_PART = _OUT + ", part int, first boolean, text binary"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.binary()]
_NAMES = [x.split()[0] for x in _PART.split(", ")]


def edit(text: bytes, following: bytes) -> bytes:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    t = text.decode()
    cut = len(t) // 4
    return (t[: len(t) - cut] + following.decode()[:cut]).encode()


def _judge(make: Fingerprinter, pairs: list[tuple]) -> list[list]:
    """Result rows of (doc_id, text, following text)."""
    texts = list(dict.fromkeys(x for _, t, f in pairs for x in (t, f, edit(t, f))))
    print_of = dict(zip(texts, make(texts), strict=True))
    out = []
    for doc_id, t, f in pairs:
        e = edit(t, f)
        own, edited = print_of[t], print_of[e]
        out.append([doc_id, len(t.decode()), hashlib.sha256(e).hexdigest(), own.tobytes(), edited.tobytes(), float((own == edited).mean()), float((own == print_of[f]).mean())])
    return out


def _walker(slots: int, seed: int):
    def run(batches):
        make, part, first, carry = Fingerprinter(slots, seed), TaskContext.get().partitionId(), None, []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
        edge = lambda row, lead: [row[0], None, None, None, None, None, None, part, lead, row[1]]
        for rows in _held(batches, HOLD_BYTES):
            first = first or rows[0]
            rows = carry + rows
            if len(rows) > 1:
                yield pack([[*r, None, None, None] for r in _judge(make, [(x[0], x[1], y[1]) for x, y in zip(rows, rows[1:], strict=False)])])
            carry = rows[-1:]
        if carry:
            yield pack([edge(first, True), edge(carry[0], False)])

    return run


def compare_with_edits(docs: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see ``edit``.

    The following document is the next by doc_id (then text); after the last comes the first. Null text counts
    as empty; a null doc_id sorts first. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row per input row. Rows are range-partitioned by doc_id once; each partition
    judges its rows in order and hands only its first and last text on, to meet its neighbours.
    """
    small_batches(docs.sparkSession)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes(docs) // RANGE_BYTES))
    ordered = _text_rows(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    parts = _settled(ordered.mapInArrow(_walker(slots, seed), _PART), "walks")
    edges = parts.where("part is not null")
    order = edges.where("first").select("part", "doc_id")
    turn = Window.orderBy("part")  # one row for each partition
    after = order.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    lasts = edges.where("not first").select("part", "doc_id", "text").join(after, "part")
    firsts = edges.where("first").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def run(batches):
        make = Fingerprinter(slots, seed)
        for b in batches:
            if b.num_rows:
                rows = _judge(make, list(zip(*(c.to_pylist() for c in b.columns), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=False)], _NAMES[:7])

    ends = lasts.join(firsts, "next").select("doc_id", "text", "following").mapInArrow(run, _OUT)
    return parts.where("part is null").select(*_NAMES[:7]).unionByName(ends).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("a")).alias("fingerprint"), F.lower(F.hex("b")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
