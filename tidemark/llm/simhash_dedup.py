"""SimHash near-dedup: fingerprints linked through a sharded vantage-point tree.

A tree fitted on a sample of distinct fingerprints, as large as its leaves need, routes every distinct fingerprint to one leaf
by its Hamming distances to the vantage points. Where the triangle inequality lets a pair straddle a
boundary, the inner fingerprint is also sent across as a query. Each leaf is searched exactly by a local
tree with the same pruning and returns a spanning forest of its links, so output stays linear even in
a dense group; the forests are joined by Spark into components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, resolve_components, small_batches

SHINGLE = 3
MAX_BITS = 2
#: Distinct fingerprints aimed at for each leaf, sampled fingerprints for each, and the most of them (8 MB on the driver).
LEAF = 4096
SAMPLED = 8
MOST_SAMPLED = 1 << 20
SEED = 42


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of an ASCII-lowered text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    start = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = (start[shingle - 1 :] - 1).tolist()
    starts = [0, *start[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprinter(shingle: int):
    def run(batches):
        for b in batches:
            fp = np.array([simhash(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as bigint) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprinter(shingle), "doc_id bigint, fp bigint"
    )


def _dist(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(v))


def grow(sample: np.ndarray, leaves: int, first: int = 0):
    """A top tree as nested (vantage, radius, inner, outer); an int is a leaf number."""
    if leaves <= 1 or len(sample) < 2:
        return first
    best = None
    for v in sample[:: max(1, len(sample) // 8)][:8]:
        d = _dist(sample, v)
        for radius in np.unique(np.quantile(d, (0.35, 0.42, 0.5, 0.58, 0.65)).astype(int)):
            inner = int((d <= radius).sum())
            if 0 < inner < len(sample):
                crossing = int(((d > radius - MAX_BITS) & (d <= radius)).sum())
                cost = crossing + abs(2 * inner - len(sample)) / 2
                if best is None or cost < best[0]:
                    best = (cost, v, int(radius), inner)
    if best is None:
        return first
    _, v, radius, inner = best
    inside = _dist(sample, v) <= radius
    left = min(leaves - 1, max(1, round(leaves * inner / len(sample))))
    return int(v), radius, grow(sample[inside], left, first), grow(sample[~inside], leaves - left, first + left)


def route(node, at: np.ndarray, fp: np.ndarray, query: np.ndarray, bits: int, out: list) -> None:
    """Send fingerprints down the tree; ``query`` rows take each branch that the bounds allow."""
    if not len(at):
        return
    if isinstance(node, int):
        out.append((node, at, query))
        return
    v, radius, inner, outer = node
    d = _dist(fp[at], v).astype(np.int64)
    inside = np.where(query, d <= radius + bits, d <= radius)
    outside = d > radius - bits
    route(inner, at[inside], fp, query[inside], bits, out)
    route(outer, at[outside], fp, (query | (d <= radius))[outside], bits, out)


def _router(tree, bits: int):
    def run(batches):
        for b in batches:
            fp = np.array(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            out: list = []
            route(tree, np.arange(len(fp)), fp, np.zeros(len(fp), bool), bits, out)
            if out:
                leaf = np.concatenate([np.full(len(at), n, np.int32) for n, at, _ in out])
                at, query = np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at].view(np.int64)), pa.array(query)], ["leaf", "fp", "query"])

    return run


class Forest:
    """Union-find over fingerprints."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link(members: np.ndarray, queries: np.ndarray, bits: int, forest: Forest) -> None:
    """Join all pairs within ``bits`` that hold a member (members among themselves, queries with members)."""
    if not len(members):
        return
    if len(members) > 256:
        v = members[len(members) // 2]
        d = _dist(members, v).astype(np.int64)
        radius = int(np.median(d))
        if d.max() == radius:
            radius -= 1
        inside = d <= radius
        if inside.any() and not inside.all():
            dq = _dist(queries, v).astype(np.int64)
            link(members[inside], queries[dq <= radius + bits], bits, forest)
            link(members[~inside], np.concatenate([queries[dq > radius - bits], members[inside & (d > radius - bits)]]), bits, forest)
            return
    for i in range(0, len(members), 256):
        part = members[i : i + 256]
        for other, own in ((members[i:], True), (queries, False)):
            for j in range(0, len(other), 8192):
                a, b = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, j : j + 8192]) <= bits)
                if own:
                    keep = a < b + j
                    a, b = a[keep], b[keep]
                for x, y in zip(part[a].tolist(), other[b + j].tolist(), strict=True):
                    forest.join(x, y)


def _leaf(bits: int):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        query = table.column("query").to_numpy(zero_copy_only=False)
        forest = Forest()
        link(fp[~query], fp[query], bits, forest)
        pairs = np.array([(x, r) for x in list(forest.up) if (r := forest.root(x)) != x], np.uint64).reshape(-1, 2)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)})

    return run


def link_fingerprints(distinct: DataFrame, bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """``node, root`` for each distinct fingerprint (column ``fp``) that links to another one."""
    leaves = max(1, min(-(-distinct.count() // leaf), MOST_SAMPLED // SAMPLED))
    small = distinct.orderBy(F.xxhash64("fp")).limit(max(1024, SAMPLED * leaves))
    sample = np.sort(small.toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64))
    routed = distinct.mapInArrow(_router(grow(sample, leaves), bits), "leaf int, fp bigint, query boolean")
    return resolve_components(routed.groupBy("leaf").applyInArrow(_leaf(bits), "a bigint, b bigint"))


def components(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: fingerprints link at ``bits`` or fewer differing bits.

    component_id is the smallest doc_id reachable, itself included. Null text counts as empty; texts
    without words have fingerprint 0 and link like any other. Rows with a null doc_id take part in linking
    and get the component's smallest non-null doc_id (null if it has none). Repeated rows stay.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    per = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = link_fingerprints(per.select("fp"), bits)
    known = per.join(roots, per.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """Documents of ``docs``, all columns, that are the smallest doc_id of their component.

    Rows that repeat a kept doc_id are kept once. Rows without a doc_id cannot be named by a group and
    stay as they are.
    """
    kept = components(docs.where("doc_id is not null"), shingle, bits).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where("doc_id is null"))
