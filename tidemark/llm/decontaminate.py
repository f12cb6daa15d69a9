"""Benchmark decontamination: CGK walks, bit-sampling LSH over item windows, exact edit verification.

Every word start of a document and of a benchmark item begins a random walk; its bytes at sampled steps are hashed.
A walk is read at the ends of ``STAGES``: an item's windows end at the stage that ``REPETITIONS`` names for its length, and
further repetitions have other walks and samples. Document walks are held against bitmaps of fixed size made from the items'
hashes, at each stage, so most end early and few leave the scan; those join the items' windows on the hash, which aligns
an item with a place. The walks of such a pair go on; for long items, their further steps must also be near in Hamming distance. Each
aligned place is verified by exact edit distance (Myers' bit vectors, many places at
a time) on the text around it. Items too short for a window are looked up by the hash of their words in a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cgk import PAD, moves
from .common import HashMemo, ascii_lower, chunks, materialize, small_batches
from .substring_dedup import window_hashes

SIMILARITY = 0.8
#: (steps, samples among them) at the end of each stage; half as many characters as steps. Windows are that short because
#: at the similarity a text has few longer stretches without an edit. The first stage only sorts out.
STAGES = ((8, 4), (16, 8), (20, 10), (24, 11))
#: (words, stage, repetitions) for items of that many words or more; see the README for the recall measured.
REPETITIONS = ((30, 3, 2), (20, 3, 4), (15, 2, 4), (0, 1, 6))
#: A walk goes on for so many steps after its window, one bit each; windows of items of ``LONG_WORDS`` words or more align only if
#: this share of the bits inside the item, and so of the steps in Hamming distance, agrees.
FURTHER, AGREE, LEAST_BITS, LONG_WORDS = 64, 0.74, 24, 15
#: Items under so many words or bytes are found only whole, as words in a row: they have no room for edits and windows.
MIN_WORDS, MIN_BYTES = 5, 20
BITMAP_BITS = 22
CHUNK_BYTES = 256 << 10
#: Items of one document that travel in one row, and places verified at a time.
ITEMS, PLACES = 256, 2048
#: Places so near count as one.
NEAR = 8
WHOLE = 100  # level of items of n words found whole: WHOLE + n


def plan(words: int, reps: int | None = None) -> tuple[int, int]:
    """Stage and repetitions for an item of so many words."""
    return next((stage, reps or n) for least, stage, n in REPETITIONS if words >= least)


def canonical(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def canonical_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), "[\\x20\\x09-\\x0D]+", " "))


class Walker:
    """Hashes of all word starts of some canonical texts, for each repetition."""

    def __init__(self, reps: int):
        self.reps = []
        for r in range(reps):
            rng, sample, step, taken = np.random.default_rng(700 + r), set(), 0, 0
            for steps, samples in STAGES:
                sample |= set((step + rng.choice(steps - step, samples - taken, replace=False)).tolist())
                step, taken = steps, samples
            self.reps.append((moves(70 + r, step + FURTHER), sample, rng.integers(0, 2, (FURTHER, 256), np.uint8)))

    def lay(self, texts: list[bytes]):
        """The texts in one array, padded, with the word starts and the text of each start."""
        pad = bytes([PAD])
        flat = np.frombuffer(b"".join(t + pad for t in texts), np.uint8)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        gap = (flat == 32) | (flat == PAD)
        start = np.flatnonzero(np.r_[True, gap[:-1]] & ~gap) if len(flat) else np.empty(0, np.int64)
        doc = np.searchsorted(np.cumsum(size), start, side="right")
        return flat, start, doc, start - (np.cumsum(size) - size)[doc]

    def hashes(self, flat: np.ndarray, start: np.ndarray, rep: int, goes_on=None):
        """(stage, indices of starts, hashes, positions) at the end of each stage.

        ``goes_on(stage, hash)`` chooses the starts that go on to the next stage.
        """
        move, sample, _ = self.reps[rep]
        at, pos, h, step = np.arange(len(start)), start.astype(np.int32), np.full(len(start), rep + 1, np.uint64), 0
        for stage, (steps, _) in enumerate(STAGES):
            for j in range(step, steps):
                c = flat.take(pos)
                if j in sample:
                    h *= np.uint64(0x100000001B3)
                    h += c
                pos += move[j].take(c)
            step = steps
            mixed = h * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            yield stage, at, mixed, pos.copy()
            if goes_on is not None and stage + 1 < len(STAGES):
                keep = goes_on(stage, mixed)
                at, pos, h = at[keep], pos[keep], h[keep]
                if not len(at):
                    return

    def further(self, flat: np.ndarray, pos: np.ndarray, rep: int, stage: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the next steps of walks, and a mask of the steps that are inside the text."""
        move, _, bit = self.reps[rep]
        pos, seen, bits = pos.copy(), np.empty((FURTHER, len(pos)), np.uint8), np.empty((FURTHER, len(pos)), np.uint8)
        for j in range(FURTHER):
            flat.take(pos, out=seen[j], mode="clip")
            bit[j].take(seen[j], out=bits[j], mode="clip")
            pos += move[STAGES[stage][0] + j].take(seen[j])
        packed = lambda x: np.ascontiguousarray(np.packbits(x, axis=0, bitorder="little").T).view(np.uint64)[:, 0]
        return packed(bits), packed(seen != PAD)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


_WINDOW = pa.schema([("level", pa.int32()), ("ends", pa.bool_()), ("hash", pa.int64()), ("item_id", pa.int64()), ("offset", pa.int32()), ("rep", pa.int32()), ("bits", pa.int64()), ("mask", pa.int64())])


def _item_windows(fixed: int | None):
    most = fixed or max(reps for *_, reps in REPETITIONS)

    def run(batches):
        walker, memo = Walker(most), HashMemo()
        for b in batches:
            rows = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t]
            whole = [(i, t) for i, t in rows if t.count(b" ") + 1 < MIN_WORDS or len(t) < MIN_BYTES]
            for i, t in whole:
                n = t.count(b" ") + 1
                h, _ = window_hashes([t.split()], n, memo)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((WHOLE + n, True, int(h.view(np.int64)[0]), i, 0, 0, 0, 0), _WINDOW.types, strict=True)], schema=_WINDOW)
            rows = [(i, t) for i, t in rows if t.count(b" ") + 1 >= MIN_WORDS and len(t) >= MIN_BYTES]
            if not rows:
                continue
            flat, start, doc, offset = walker.lay([t for _, t in rows])
            ids = np.array([i for i, _ in rows], np.int64)
            stages, turns = np.array([plan(t.count(b" ") + 1, fixed) for _, t in rows]).T
            long = np.array([t.count(b" ") + 1 >= LONG_WORDS for _, t in rows])
            for rep in range(turns.max()):
                for stage, _, h, pos in walker.hashes(flat, start, rep):
                    bits, inside = walker.further(flat, pos, rep, stage)
                    # The windows at the end of a long item have no further steps to compare; those before them do.
                    ok = (turns[doc] > rep) & (stages[doc] >= stage) & (flat[pos] != PAD) & (~long[doc] | (np.bitwise_count(inside) >= LEAST_BITS) | (stages[doc] > stage))
                    mask = np.where(long[doc], inside, 0)
                    cols = (np.full(int(ok.sum()), stage, np.int32), (stages[doc] == stage)[ok], h[ok].view(np.int64), ids[doc[ok]], offset[ok].astype(np.int32), np.full(int(ok.sum()), rep, np.int32), bits[ok].view(np.int64), mask[ok].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_WINDOW)

    return run


def _scanner(reps: int, bitmaps):
    def run(batches):
        walker, memo = Walker(reps), HashMemo()
        bits = {k: np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for k, v in bitmaps.value.items()}
        none = np.zeros(1 << BITMAP_BITS, bool)
        sizes = sorted(k - WHOLE for k, ends in bits if k > WHOLE and ends)

        def out(level, h, doc, place, further):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), level, np.int32)), pa.array(h.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(further.view(np.int64))], ["level", "hash", "doc_id", "place", "further"])

        for rows in chunks(batches, lambda r: len(r[1] or b""), CHUNK_BYTES):
            rows = [(i, t) for i, t in ((i, canonical(t)) for i, t in rows if i is not None) if t]
            ids = np.array([i for i, _ in rows], np.int64)
            if sizes:
                words = [t.split() for _, t in rows]
                for n in sizes:
                    h, count = window_hashes(words, n, memo)
                    hit = bits[WHOLE + n, True][_slots(h)]
                    yield out(WHOLE + n, h[hit], np.repeat(ids, count)[hit], np.full(int(hit.sum()), -1), np.zeros(int(hit.sum()), np.int64))
            flat, start, doc, offset = walker.lay([t for _, t in rows])
            for rep in range(reps):
                for stage, at, h, pos in walker.hashes(flat, start, rep, lambda stage, h: bits.get((stage, False), none)[_slots(h)]):
                    hit = bits.get((stage, True), none)[_slots(h)]
                    if hit.any():
                        at, h = at[hit], h[hit]
                        yield out(stage, h, ids[doc[at]], offset[at], walker.further(flat, pos[hit], rep, stage)[0])

    return run


def substring_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For each (pattern, text), the least edit distance of the pattern to any substring of the text.

    Myers' bit vectors over all pairs at once. Patterns end at the top bit; the bits below a pattern match anything.
    """
    if not pairs:
        return np.empty(0, np.int64)
    patterns = list(dict.fromkeys(p for p, _ in pairs))
    row = {p: i for i, p in enumerate(patterns)}
    points = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    letters = np.unique(np.concatenate([points(p) for p in patterns]))
    kinds, words = len(letters) + 1, max(1, -(-max(map(len, patterns)) // 64))
    match = np.zeros((words, len(patterns), kinds), np.uint64)
    real = np.zeros((words, len(patterns)), np.uint64)
    for i, p in enumerate(patterns):
        bit = 64 * words - len(p) + np.arange(len(p))
        one = np.uint64(1) << (bit % 64).astype(np.uint64)
        np.bitwise_or.at(match, (bit // 64, i, np.searchsorted(letters, points(p))), one)
        np.bitwise_or.at(real, (bit // 64, i), one)
    match |= ~real[:, :, None]
    match = match.reshape(words, -1)
    size = np.fromiter((len(t) for _, t in pairs), np.int64, len(pairs))
    codes = np.full((len(pairs), int(size.max())), len(letters), np.int32)
    for i, (_, t) in enumerate(pairs):
        x = points(t)
        at = np.minimum(np.searchsorted(letters, x), len(letters) - 1)
        codes[i, : len(x)] = np.where(letters[at] == x, at, len(letters))
    of = np.fromiter((row[p] for p, _ in pairs), np.int32, len(pairs))
    codes = np.ascontiguousarray((codes + (of * kinds)[:, None]).T)
    pv, mv = real[:, of].copy(), np.zeros((words, len(pairs)), np.uint64)
    score = np.fromiter((len(p) for p, _ in pairs), np.int64, len(pairs))
    best, top = score.copy(), np.uint64(63)
    one = np.uint64(1)
    for c in codes:
        carry = up = down = None
        for w in range(words):
            eq = match[w].take(c)
            p, m = pv[w], mv[w]
            xh = eq & p
            xh += p
            over = xh < p
            if w:
                xh += carry
                over |= xh < carry
            if w + 1 < words:
                carry = over.astype(np.uint64)
            xh ^= p
            xh |= eq
            eq |= m
            mh = p & xh
            ph = ~(xh | p)
            ph |= m
            pt, mt = ph >> top, mh >> top
            ph <<= one
            mh <<= one
            if w:
                ph |= up
                mh |= down
            up, down = pt, mt
            np.bitwise_and(ph, eq, out=m)
            ph |= eq
            np.invert(ph, out=ph)
            np.bitwise_or(mh, ph, out=p)
        score += up.view(np.int64)
        score -= down.view(np.int64)
        np.minimum(best, score, out=best)
    return best


def substring_distance(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of the pattern to any substring of the text, if at most ``most``."""
    d = int(substring_distances([(pattern, text)])[0])
    return d if d <= most else None


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])


def _width(text: bytes) -> int:
    """Most bytes of a character."""
    most = int(np.frombuffer(text, np.uint8).max(initial=0))
    return 1 if most < 0x80 else 2 if most < 0xE0 else 3 if most < 0xF0 else 4


def _regions(item: bytes, own: bytes, places: list[int], most: int, wide: int):
    """The stretches of ``own`` that alignments at ``places`` can reach; near places share one."""
    slack = most * wide  # bytes by which the edits before the window can move its start, and those after it its end
    held = None
    for place in sorted(places):
        lo, hi = max(0, place - slack), place + NEAR + len(item) + slack
        if held and lo <= held[0] + 64:
            held = held[0], hi
            continue
        if held:
            yield own[held[0] : held[1]].decode("utf-8", "ignore")
        held = lo, hi
    if held:
        yield own[held[0] : held[1]].decode("utf-8", "ignore")


def _verifier(similarity: float):
    def judged(todo):
        """Rows of the aligned (doc_id, item_id, item, region); the most similar patterns in size go together."""
        out = []
        todo.sort(key=lambda x: (len(x[2]) // 64, len(x[3])))
        for i in range(0, len(todo), PLACES):
            part = todo[i : i + PLACES]
            for (doc_id, item_id, item, _), d in zip(part, substring_distances([x[2:] for x in part]).tolist(), strict=True):
                if d <= int((1 - similarity) * len(item) + 1e-9):
                    out.append((doc_id, item_id, d, 1 - d / len(item)))
        return out

    def run(batches):
        for b in batches:
            out, todo = [], []
            for doc_id, text, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = canonical(text)
                wide = _width(own)
                for x in items:
                    item = x["item"]
                    if item in own and (not x["whole"] or b" " + item + b" " in b" " + own + b" "):
                        out.append((doc_id, x["item_id"], 0, 1.0))
                    elif not x["whole"]:
                        pattern = item.decode()
                        todo += [(doc_id, x["item_id"], pattern, r) for r in _regions(item, own, x["places"], int((1 - similarity) * len(pattern) + 1e-9), max(wide, _width(item)))]
                if len(todo) >= 8 * PLACES:
                    out, todo = out + judged(todo), []
            out += judged(todo)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, _FOUND.types, strict=True)], schema=_FOUND)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, reps: int | None = None) -> DataFrame:
    """``doc_id, item_id, distance, similarity``: items found in documents.

    An item is found if a passage of the document is within an edit distance of (1 - similarity) of the item's
    characters, on lower-cased (A-Z) words joined by one space. Items under five words or 20 bytes are found only whole, as words
    in a row. Null or empty texts and rows without an id are never reported; of rows that repeat a doc_id or an item_id, the
    nearest counts. Empty tables: no rows. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), canonical_column(F.col("text")).alias("item")).where("item_id is not null and item <> ''").distinct()
    named = materialize(named, "items")  # equal items are looked for once
    items = named.groupBy("item").agg(F.min("item_id").alias("item_id"))
    windows = materialize(items.select("item_id", F.col("item").cast("binary").alias("item")).mapInArrow(_item_windows(reps), "level int, ends boolean, hash bigint, item_id bigint, offset int, rep int, bits bigint, mask bigint"), "item-windows")
    slot = windows.select("level", "ends", "rep", F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("s"))
    kinds = slot.groupBy("level", "ends").agg(F.max("rep").alias("rep")).collect()  # a row for each stage and short length
    bitmaps = {}
    for r in kinds:
        slots = slot.where((F.col("level") == r["level"]) & (F.col("ends") == r["ends"])).select("s").distinct().toArrow()
        bits = np.zeros(1 << BITMAP_BITS, np.uint8)
        bits[slots.column("s").to_numpy()] = 1
        bitmaps[r["level"], r["ends"]] = np.packbits(bits).tobytes()  # 2**22 bits, whatever the benchmark's size
    turns = max((r["rep"] + 1 for r in kinds if r["level"] < WHOLE), default=0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hits = rows.mapInArrow(_scanner(turns, spark.sparkContext.broadcast(bitmaps)), "level int, hash bigint, doc_id bigint, place int, further bigint")
    keyed = windows.where("ends").select("level", "hash", "item_id", "offset", "bits", "mask").distinct()
    unlike = F.bit_count(F.col("further").bitwiseXOR(F.col("bits")).bitwiseAND(F.col("mask")))
    whole = F.col("level") > WHOLE
    place = F.when(whole, -1).otherwise(F.floor((F.col("place") - F.col("offset")) / NEAR) * NEAR).cast("int")
    places = hits.join(keyed, ["level", "hash"]).where(unlike <= (1 - AGREE) * F.bit_count("mask")).select("doc_id", "item_id", whole.alias("whole"), place.alias("place"))
    found = materialize(places.groupBy("doc_id", "item_id", "whole").agg(F.collect_set("place").alias("places")), "aligned")
    # A document of many items is read in several rows, so that none holds a list without bound.
    parts = found.groupBy("doc_id").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("item_id"), F.col("parts"))
    lists = found.join(parts, "doc_id").join(items.select("item_id", F.col("item").cast("binary").alias("item")), "item_id")
    lists = lists.groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("item_id", "item", "whole", "places")).alias("items"))
    checked = rows.join(lists, "doc_id").select("doc_id", "text", "items").mapInArrow(_verifier(similarity), "doc_id bigint, item_id bigint, distance int, similarity double")
    best = checked.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))
    low = named.join(items.withColumnRenamed("item_id", "of"), "item").select("item_id", "of")
    best = best.withColumnRenamed("item_id", "of").join(low, "of")
    return best.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents, all columns, in which no item is found. Rows without a doc_id stay."""
    return docs.join(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
