"""LM scoring: prediction by partial matching over bytes, and an add-one unigram baseline.

PPM. Texts are lower-cased (A-Z) token sequences joined by one space, closed by an end symbol. The model counts
every (context, symbol) pair of ``ORDER`` context bytes, and of all shorter contexts, over all training documents;
no pair is dropped, so it grows with the input. Escapes follow method D (half a count of
each distinct symbol goes to the escape). Because the symbol
sets are nested, exclusion after an escape needs three numbers for a context: its total, its distinct
symbols and the total that those symbols have in its suffix. The model is pretrained and fixed; scoring is
table lookups over whole texts.

The trie lies in shards: ranges of contexts ordered by their last byte first, so a shard holds whole subtrees. Only
contexts on the path to a shard's two ends cross shards; those counts are summed over all shards and given to the
shards they touch. Chunks of documents send each shard their distinct pairs with training counts and
get log probabilities back.

Baseline. The same chunks send each hash range their words'
hashes and training counts; the range replies with corpus counts. Word identity is a 64-bit
hash. Nothing grows with the vocabulary or the trie on the driver or in a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, chunks, materialize, small_batches, total_bytes
from .substring_dedup import planes, unplanes

ORDER = 5
CHUNK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
RANGE_BYTES = 32 << 20
MERGE_KEYS = 1_000_000
#: Text from which the shards' ends are drawn, and one in how many of its contexts; results don't depend on them.
SAMPLE_BYTES, SAMPLE_STEP = 16 << 20, 32
START, END = 0xFE, 0xFF  # never in UTF-8
END_WORD = b" "  # holds a space, so no word equals it
SYMBOLS = 256  # 255 bytes and the end


def canonical(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def pieces(texts: list[bytes]):
    """Slices of ``texts`` of about PIECE_BYTES, to bound memory."""
    cut = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // PIECE_BYTES, prepend=0))
    edge = [0, *(c for c in cut.tolist() if c), len(texts)]
    yield from (slice(a, b) for a, b in zip(edge, edge[1:], strict=False))


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 8 | symbol) of every position of some texts, and the positions of each text.

    A context's last byte is its most significant one.
    """
    pad = bytes([START]) * order
    b = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    key = np.zeros(max(0, len(b) - order), np.uint64)
    for j in (*range(order - 1, -1, -1), order):
        key <<= np.uint64(8)
        key |= b[j : j + len(key)]
    ends = np.cumsum(size + order)
    skip = np.ones(len(key), bool)
    for j in range(1, order + 1):
        skip[ends[:-1] - j] = False  # would predict the next text's padding
    return key[skip], size


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k)
    k, n = k[o], n[o]
    s = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[s], np.add.reduceat(n, s) if len(s) else n


def merged(parts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` over a stream of keys and counts, merged as they pile up so that memory follows the distinct keys."""
    held, n = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > max(least, len(held[0][0])):
            held, n = [summed(*zip(*held, strict=True))], 0
    return summed(*zip(*held, strict=True))


def gram_counts(texts: list[bytes], held: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all texts with their counts in those that are not held out."""

    def parts():
        for part in pieces(texts):
            for out in (False, True):
                some = [t for t, h in zip(texts[part], held[part], strict=True) if h == out]
                if some:
                    key, c = np.unique(grams(some, order)[0], return_counts=True)
                    yield key, np.zeros_like(c) if out else c

    return merged(parts(), MERGE_KEYS // 4)


def word_hashes(texts: list[bytes], memo: HashMemo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and the number of each text."""
    per = [np.fromiter(map(memo.__getitem__, [*t.split(), END_WORD]), np.uint64) for t in texts]
    return np.concatenate(per), np.fromiter(map(len, per), np.int64, len(per))


class Trie:
    """A fixed model: for each order, sorted pair keys with counts and sorted contexts with their totals."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.pairs, self.contexts = levels, []
        for k, (key, n) in enumerate(levels):
            ctx = key >> np.uint64(8)
            s = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.empty(0, np.int64)
            total, distinct = (np.add.reduceat(n, s), np.diff(np.r_[s, len(ctx)])) if len(s) else (n, n)
            below = np.zeros(len(s), np.int64)
            if k and len(s):
                below = np.add.reduceat(self._count(k - 1, self.cut(key)), s)
            self.contexts.append((ctx[s], total, distinct, below))

    @staticmethod
    def cut(key: np.ndarray) -> np.ndarray:
        """Pair keys without the oldest context byte."""
        return key >> np.uint64(16) << np.uint64(8) | key & np.uint64(0xFF)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _count(self, k: int, key: np.ndarray) -> np.ndarray:
        at, hit = self.find(self.pairs[k][0], key)
        return np.where(hit, self.pairs[k][1][at] if len(self.pairs[k][1]) else 0, 0)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of highest-order pair keys, with escapes and exclusion."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        out_total, out_distinct = np.zeros(len(key)), np.zeros(len(key))  # excluded at this order
        for k in range(self.order, -1, -1):
            ctx, total, distinct, below = self.contexts[k]
            at, seen = self.find(ctx, key >> np.uint64(8))
            n, d, b = (np.where(seen, x[at] if len(x) else 0, 0) for x in (total, distinct, below))
            left, kinds = n - out_total, d - out_distinct
            c = self._count(k, key)
            here = seen & (c > 0)
            out[todo[here]] += np.log10((2 * c[here] - 1) / (2 * left[here]))
            away = seen & ~here & (kinds > 0)
            out[todo[away]] += np.log10(kinds[away] / (2 * left[away]))
            on = ~here
            todo, out_total, out_distinct = todo[on], np.where(seen, b, 0)[on], np.where(seen, d, 0)[on]
            key = self.cut(key[on])
        out[todo] -= np.log10(np.maximum(1, SYMBOLS - out_distinct))
        return out


class Table:
    """Open-addressing table of distinct keys: ``find`` gives their places in the array."""

    def __init__(self, key: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(key)) - 1).bit_length())
        self.slots, self.place = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.zeros(1 << self.bits, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.slots[at[left]] == np.uint64(2**64 - 1)
            self.slots[at[left[free]]] = key[left[free]]  # the last of equals wins
            won = self.slots[at[left]] == key[left]
            self.place[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of keys that are all in the table."""
        at = self._slot(key)
        off = np.flatnonzero(self.slots[at] != key)
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            off = off[self.slots[at[off]] != key[off]]
        return self.place[at]


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(planes(values), 3)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    return unplanes(zstandard.decompress(blob), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def shard_ends(rows: DataFrame, order: int, shards: int, size: int) -> np.ndarray:
    """First contexts of all shards but the first, at quantiles of a sample's contexts."""

    def run(batches):
        for got in chunks(batches, lambda r: len(r[0] or b""), PIECE_BYTES):
            ctx = np.unique(grams([canonical(r[0]) for r in got], order)[0] >> np.uint64(8))
            ctx = ctx[(ctx * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) & np.uint64(SAMPLE_STEP - 1) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64))], ["ctx"])

    some = rows.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, size)), seed=1).mapInArrow(run, "ctx bigint")
    ctx = np.sort(some.toArrow().column("ctx").to_numpy()).astype(np.uint64)
    if not len(ctx):
        return ctx
    return np.setdiff1d(ctx[np.arange(1, shards) * len(ctx) // shards], [0]).astype(np.uint64)


def paths(ends: np.ndarray, shard: int, order: int) -> list[np.ndarray]:
    """For each order below the highest, the contexts on the paths to the ends of a shard."""
    near = ends[max(0, shard - 1) : shard + 1]
    return [np.unique(near >> np.uint64(8 * (order - k))) for k in range(order)]


def _needs(order: int, buckets: int, ends: np.ndarray):
    """The contexts that each shard needs from others."""

    def run(batches):
        for b in batches:
            rows = [(buckets + s, k, int(c)) for s in b.column(0).to_pylist() for k, ctx in enumerate(paths(ends, s, order)) for c in ctx]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["bucket", "k", "ctx"])

    return run


_REC = "chunk bigint, bucket bigint, doc_id array<bigint>, held array<boolean>, a binary, b binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("a", pa.binary()), ("b", pa.binary())])


def _chunker(order: int, buckets: int, ends: np.ndarray):
    """Records (bucket -1) hold texts; word hashes go to buckets from 0, pairs to buckets from ``buckets``."""
    hash_edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _ARROW.types, strict=True)], schema=_ARROW)

    def packs(chunk, first, keys, n, edges):
        at = np.searchsorted(keys, edges)
        for b, (lo, hi) in enumerate(zip(np.r_[0, at], np.r_[at, len(keys)], strict=True)):
            if hi > lo:
                yield row(chunk, first + b, None, None, pack_sorted(keys[lo:hi]), pack(n[lo:hi].astype(np.int64)))

    def run(batches):
        memo, seq = HashMemo(), 0
        for rows in chunks(batches, lambda r: len(r[1] or b"") + 64, CHUNK_BYTES):
            texts, held = [canonical(r[1]) for r in rows], np.array([r[2] for r in rows])
            chunk = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            yield row(chunk, -1, [r[0] for r in rows], held, zstandard.compress(b"\n".join(texts), 6), None)
            h, n = word_hashes(texts, memo)
            uniq, word = np.unique(h, return_inverse=True)
            train = np.bincount(word, weights=np.repeat(~held, n), minlength=len(uniq))
            yield from packs(chunk, 0, uniq, train, hash_edges)
            yield from packs(chunk, buckets, *gram_counts(texts, held, order), ends << np.uint64(8))

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of packs."""
    return merged(((unpack_sorted(a.as_py()), unpack(b.as_py(), np.int64)) for a, b in zip(table.column("a"), table.column("b"), strict=True)), MERGE_KEYS)


def _replies(table: pa.Table, uniq: np.ndarray, values: np.ndarray) -> list[bytes]:
    """For each pack, the values at its keys."""
    return [pack(values[np.searchsorted(uniq, unpack_sorted(a.as_py()))]) for a in table.column("a")]


def _word_reply(table: pa.Table) -> pa.Table:
    """A hash range's corpus counts for each chunk, with the range's tokens and distinct words."""
    uniq, total = _merged(table)
    first = [0] * (table.num_rows - 1)
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "c": pa.array(_replies(table, uniq, total), pa.binary()), "tokens": pa.array([int(total.sum()), *first], pa.int64()), "distinct": pa.array([int((total > 0).sum()), *first], pa.int64())})


def _own_levels(key: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pair counts of one shard, order by order from zero."""
    levels = [(key[n > 0], n[n > 0])]
    for _ in range(order):
        levels.insert(0, summed([Trie.cut(levels[0][0])], [levels[0][1]]))
    return levels


def _crossing(order: int, buckets: int, ends: np.ndarray):
    """A shard's part of the counts of contexts that may cross its ends."""

    def run(table: pa.Table) -> pa.Table:
        shard, out = table.column("bucket")[0].as_py() - buckets, []
        for k, ((key, n), ctx) in enumerate(zip(_own_levels(*_merged(table), order), paths(ends, shard, order), strict=False)):
            on = np.isin(key >> np.uint64(8), ctx)
            out.append(pa.table({"k": pa.array([k] * int(on.sum()), pa.int32()), "key": key[on].view(np.int64), "n": n[on]}))
        return pa.concat_tables(out)

    return run


def _shard_reply(order: int, buckets: int, ends: np.ndarray):
    """Log probabilities for each chunk's pairs, from the shard's own pairs and the crossing contexts."""

    def run(table: pa.Table, crossing: pa.Table) -> pa.Table:
        uniq, counts = _merged(table)
        levels = _own_levels(uniq, counts, order)
        got_k, got_ctx = (crossing.column(c).to_numpy() for c in ("k", "ctx"))
        sym, n = (crossing.column(c) for c in ("sym", "n"))
        for k in range(order):
            key, own = levels[k]
            rows = np.flatnonzero(got_k == k)
            keep = ~np.isin(key >> np.uint64(8), got_ctx[rows].astype(np.uint64))
            more = [np.uint64(got_ctx[r]) << np.uint64(8) | np.array(sym[r].as_py(), np.uint64) for r in rows]
            levels[k] = summed([key[keep], *more], [own[keep], *(np.array(n[r].as_py(), np.int64) for r in rows)])
        blobs = _replies(table, uniq, Trie(levels).log10(uniq).astype(np.float32))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "c": pa.array(blobs, pa.binary())})

    return run


def _finisher(order: int, buckets: int, tokens: int, distinct: int):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(record: pa.Table, replies: pa.Table) -> pa.Table:
        got = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        c = np.concatenate([unpack(r["c"], np.int64) for r in got if r["bucket"] < buckets])
        lp = np.concatenate([unpack(r["c"], np.float32) for r in got if r["bucket"] >= buckets])
        row = record.to_pylist()[0]
        texts = zstandard.decompress(row["a"]).split(b"\n")
        h, n = word_hashes(texts, HashMemo())
        c = c[np.unique(h, return_inverse=True)[1]]
        at = np.cumsum(n) - n
        base = np.add.reduceat(np.log10(c + 1.0), at) - n * np.log10(tokens + distinct + 1.0)
        known = np.add.reduceat((c > 0).astype(np.int64), at)
        table = Table(gram_counts(texts, np.zeros(len(texts), bool), order)[0])
        score = []
        for part in pieces(texts):
            key, size = grams(texts[part], order)
            score.append(np.add.reduceat(lp[table.find(key)].astype(np.float64), np.cumsum(size) - size))
        cols = (row["doc_id"], row["held"], n, known, [tokens] * len(n), base, np.concatenate(score))
        return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    return run


def score_documents(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out``: a boolean column; the other rows train both models (null counts as training). Null text counts
    as empty: one token, the end. Repeated rows are all scored and all train. Without training rows, the
    baseline gives every token log10(1 / 1) and PPM gives every symbol 1 / 256. Empty input: empty output.
    ``order``: context bytes, 1 to 6.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = total_bytes(docs)
    buckets = max(4, -(-size // RANGE_BYTES))
    ends = shard_ends(rows, order, buckets, size)
    parts = materialize(rows.mapInArrow(_chunker(order, buckets, ends), _REC), "chunks")
    packs = parts.select("chunk", "bucket", "a", "b")
    words = packs.where((F.col("bucket") >= 0) & (F.col("bucket") < buckets)).groupBy("bucket").applyInArrow(_word_reply, "chunk bigint, bucket bigint, c binary, tokens bigint, distinct bigint")
    words = materialize(words, "counts")
    total = words.agg(F.sum("tokens"), F.sum("distinct")).first()
    pairs = packs.where(F.col("bucket") >= buckets)
    crossing = pairs.groupBy("bucket").applyInArrow(_crossing(order, buckets, ends), "k int, key bigint, n bigint")
    crossing = crossing.groupBy("k", "key").agg(F.sum("n").alias("n"))
    crossing = crossing.groupBy("k", F.shiftrightunsigned("key", 8).alias("ctx")).agg(F.collect_list(F.struct(F.col("key").bitwiseAND(255).alias("sym"), "n")).alias("p"))  # at most 256
    need = spark.range(len(ends) + 1).mapInArrow(_needs(order, buckets, ends), "bucket bigint, k int, ctx bigint")
    crossing = need.join(crossing, ["k", "ctx"])
    crossing = crossing.select("bucket", "k", "ctx", F.col("p.sym").alias("sym"), F.col("p.n").alias("n"))
    scores = pairs.groupBy("bucket").cogroup(crossing.groupBy("bucket")).applyInArrow(_shard_reply(order, buckets, ends), "chunk bigint, bucket bigint, c binary")
    replies = words.select("chunk", "bucket", "c").unionByName(scores)
    records = parts.where("bucket = -1").drop("bucket", "b")
    return records.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _finisher(order, buckets, total[0] or 0, total[1] or 0), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
