"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark, merged into removal spans.

1. Map: words of each document are hashed, a polynomial hash mod 2**64 covers every window of
   ``window`` words. A chunk of documents keeps one entry per hash (the smallest doc_id in the chunk), so
   a passage held by a third of all rows is sent once per chunk. Entries travel as packed blobs, one per
   hash range; each holds the doc_ids of its own entries, so the output does not grow with the number of ranges.
2. Reduce: each hash range finds the smallest doc_id of every hash; the other holders' hashes go out in packs,
   one for each group of documents.
3. Each group of documents meets its packs, and repeated windows are merged into maximal spans.

The number of hash ranges follows the input's size, so a task's share stays the same at any scale. Hashes
have 64 bits: two different windows among n collide with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, chunks, small_batches, total_bytes

WINDOW = 13
#: Bytes of text for each hash range, for each document group, and held at once by a worker.
RANGE_BYTES = 16 << 20
PACK_BYTES = 3 << 20
CHUNK_BYTES = 6 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOB = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits (in place)."""
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mul)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(words: list[list[bytes]], window: int, memo: HashMemo) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of some documents, and the number of windows of each."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    w = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    count = np.maximum(n - window + 1, 0)
    if not count.any():
        return np.empty(0, np.uint64), count
    h = np.zeros(len(w) - window + 1, np.uint64)
    for j in range(window):
        h *= BASE
        h += w[j : j + len(h)]
    first = np.cumsum(n) - n
    at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    return mix(h[at]), count


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the equal high bytes of sorted values then compress well."""
    return values[:, None].view(np.uint8).T.tobytes()


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8).reshape(size, -1).T.copy().view(kind)[:, 0]


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigints."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (p5 + np.uint64(42 + 8)) ^ (turn(x.view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _by_doc(doc: np.ndarray, h: np.ndarray):
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for d, part in zip(doc[np.r_[0, cuts]] if len(doc) else (), np.split(h, cuts), strict=False):
        yield int(d), np.unique(part).tobytes()


def _mapper(window: int, buckets: int):
    def run(batches):
        memo = HashMemo()
        for rows in chunks(batches, lambda r: len(r[1] or b""), CHUNK_BYTES):
            rows = sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            h, count = window_hashes([r[1].split() for r in rows], window, memo)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(rows), dtype=np.uint32), count)
            order = np.argsort(h)
            h, row = h[order], row[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            low = np.minimum.reduceat(row, start)
            later = ids[row] > np.repeat(ids[low], np.diff(np.r_[start, len(h)]))
            out = {k: [] for k in _BLOB.names}

            def put(*values, out=out):
                for k, v in zip(_BLOB.names, values, strict=True):
                    out[k].append(v)

            for d, blob in _by_doc(ids[row[later]], h[later]):
                put(hash(d) % buckets, d, blob, None)
            h = h[start]
            edges = np.searchsorted(h, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64))
            for b, (lo, hi) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(h)], strict=True)):
                if hi > lo:
                    put(b, None, planes(h[lo:hi]), planes(ids[low[lo:hi]]))
            yield pa.RecordBatch.from_pydict(out, schema=_BLOB)

    return run


def _reducer(packs: int):
    def run(table: pa.Table) -> pa.Table:
        """One hash range: the hashes that documents must give up, packed by document group. Rows that carry a doc_id pass."""
        doc, hs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        held, of = [], []
        for _, d, h, docs in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if d is not None:
                hs.append(np.frombuffer(h, np.uint64))
                doc.append(np.full(len(hs[-1]), d))
            else:
                held.append(unplanes(h, np.uint64))
                of.append(unplanes(docs, np.int64))
        if held:
            h, d = np.concatenate(held), np.concatenate(of)
            order = np.argsort(h)
            h, d = h[order], d[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            low = np.repeat(np.minimum.reduceat(d, start), np.diff(np.r_[start, len(h)]))
            doc.append(d[d > low])
            hs.append(h[d > low])
        d, h = np.concatenate(doc), np.concatenate(hs)
        pack = (spark_hash(d) % packs).astype(np.int32)
        order = np.lexsort((d, pack))
        pack, d, h = pack[order], d[order], h[order]
        cut = np.flatnonzero(np.diff(pack)) + 1
        out = {"pack": pack[np.r_[0, cut]] if len(pack) else [], "docs": [planes(x) for x in np.split(d, cut) if len(x)], "hashes": [x.tobytes() for x in np.split(h, cut) if len(x)]}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.binary(), pa.binary()), strict=True)})

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])


def _finisher(window: int):
    memo = HashMemo()

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        """A document group and the hashes that its documents must give up."""
        d = np.concatenate([np.empty(0, np.int64), *(unplanes(x, np.int64) for x in packs.column("docs").to_pylist())])
        h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in packs.column("hashes").to_pylist())])
        gone = dict(_by_doc(d, h))
        out = {k: [] for k in _OUT.names}
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            words = (text or b"").split()
            spans, kept = [], words
            if doc_id in gone:
                own, _ = window_hashes([words], window, memo)
                hit = np.flatnonzero(np.isin(own, np.frombuffer(gone[doc_id], np.uint64)))
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > window) + 1
                    lo, hi = hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]] + window
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]
                    edge = [0, *(x for s in spans for x in s.values()), len(words)]
                    kept = [w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]]
            for k, v in zip(_OUT.names, (doc_id, len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")), strict=True):
                out[k].append(v)
        return pa.table(out, schema=_OUT)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller doc_id.

    ``docs`` needs ``doc_id`` (bigint) and ``text``; other columns are ignored. Returns ``doc_id, n_words,
    n_removed, spans`` (maximal removed intervals, in words, end exclusive) and ``kept_text`` (kept words
    joined by one space), one row per input row. Null or empty text: no words. Fewer than ``window``
    words: nothing removed. Rows that share a doc_id never remove from each other; a null doc_id neither
    removes nor is removed from. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    size = total_bytes(docs)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    packs = max(buckets, -(-size // PACK_BYTES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blobs = rows.mapInArrow(_mapper(window, buckets), "bucket int, doc_id bigint, hashes binary, docs binary")
    found = blobs.groupBy("bucket").applyInArrow(_reducer(packs), "pack int, docs binary, hashes binary")
    spread = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(packs))).otherwise(F.pmod(F.xxhash64("text"), F.lit(packs))).cast("int")
    return rows.withColumn("pack", spread).groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(
        _finisher(window), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string"
    )
