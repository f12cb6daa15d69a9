"""Near copies by similarity: pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are groups of texts: the components of the vantage-point tree over SimHash fingerprints of the
same shingles, and buckets of equal MinHash bands. At 0.8, fingerprints of 64 bits differ in 10 bits, where
the triangle bounds prune nothing, so the tree alone finds exact copies and small edits; the bands find the
rest (1 - (1 - 0.8 ** 6) ** 20 = 0.998 of the pairs at 0.8). Each group's members meet its best connected
member, exactly, on the whole sets. All texts of the groups that are not one component by then go through an exact prefix
filter: with each set in order of rarity, similar sets share one of their first elements, at places that leave room for the
overlap. A text with many words of its own has no such partner, so a hot group of loosely related texts makes few pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, discard, materialize, resolve_components, small_batches
from .simhash_dedup import MAX_BITS, link_fingerprints

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Members of a group that one task compares with the group's leader.
SALT_ROWS = 2000

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_MUL = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_STEP = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int, memo: HashMemo) -> np.ndarray:
    """64-bit hash of each word shingle of an ASCII-lowered text (fewer words: of the whole sequence)."""
    words = text.lower().split()
    w = np.fromiter((memo[x] for x in words), np.uint64, len(words))
    k = min(shingle, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mix(h + w[j : j + n] * _STEP[j % 64])
    return h


def simhash(h: np.ndarray) -> int:
    """A bit is set if over half the hashes have it; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def bands(s: np.ndarray) -> list[int]:
    """MinHash bands of a set of hashes, each a 64-bit digest that differs between bands."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, ((s[i : i + 512, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _key(s: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(s.tobytes(), 1))


_SIGNATURE = "doc_id bigint, key bigint, n int, fp bigint, bands array<bigint>"


def _signatures(shingle: int):
    def run(batches):
        memo = HashMemo()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t or b"", shingle, memo)
                s = np.unique(h)
                out.append((_key(s), len(s), simhash(h), bands(s) if len(s) else []))
            key, n, fp, band = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array(x, k) for x, k in zip((key, n, fp, band), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "key", "n", "fp", "bands"])

    return run


def _sets(shingle: int):
    def run(batches):
        memo = HashMemo()
        for b in batches:
            for t in b.column(0).to_pylist():
                s = np.unique(shingle_hashes(t or b"", shingle, memo))
                row = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_key(s)], pa.int64()), row], ["key", "words"])

    return run


def _rows(docs: DataFrame, *cols: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(c).cast("bigint").alias(c) for c in cols), F.col("text").cast("binary").alias("text"))


def candidate_groups(texts: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``bucket, key, n, degree``: groups of two or more different texts (``key, n, fp, bands``).

    ``degree`` is the summed size of the text's groups; a text in the middle of its copies has the largest.
    """
    tree = link_fingerprints(texts.where("n > 0").select("fp").distinct(), bits)
    at = texts.where("n > 0").join(tree.select(F.col("node").alias("fp"), "root"), "fp", "left")
    buckets = F.concat("bands", F.array(F.xxhash64(F.lit("tree"), F.coalesce("root", "fp"))))
    flat = at.select("key", "n", F.explode(buckets).alias("bucket"))
    size = flat.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = flat.join(size, "bucket")
    per = shared.groupBy("key").agg(F.first("n").alias("n"), F.sum("size").alias("degree"), F.collect_list("bucket").alias("bucket"))
    return per.select(F.explode("bucket").alias("bucket"), "key", "n", "degree")


@dataclass(frozen=True)
class Overlap:
    """How many elements two sets must share: for a Jaccard similarity, or (``jaccard`` false) a share of sets of one size."""

    similarity: float
    jaccard: bool = True

    def least(self, n: Column) -> Column:
        """With any partner; also the least size of a partner."""
        return F.ceil(self.similarity * n - 1e-9)

    def pair(self, n: Column, m: Column) -> Column:
        return F.ceil(self.similarity / (1 + self.similarity) * (n + m) - 1e-9) if self.jaccard else self.least(n)


def verified(pairs: DataFrame, sets: DataFrame, overlap: Overlap) -> DataFrame:
    """The links ``a, b`` among ``key, n, leader, m``, by the whole sets. A leader of many pairs is split over tasks."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    leaders = sets.join(salts, sets.key == salts.leader).select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("words").alias("theirs"))
    dealt = pairs.join(salts, "leader").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).drop("salts")
    both = F.size(F.array_intersect("words", "theirs"))
    met = dealt.join(sets, "key").join(leaders, ["leader", "salt"])
    return materialize(met.where(both >= overlap.pair(F.col("n"), F.col("m"))).select(F.col("key").alias("a"), F.col("leader").alias("b")), "links")


def rare_pairs(texts: DataFrame, sets: DataFrame, overlap: Overlap) -> DataFrame:
    """``key, n, leader, m``: each pair of ``texts`` (``key, comp, n``) of two components that can have the overlap, once.

    Elements are ordered by the number of sets that have them, then by value; an element of one set only takes a place
    but joins nothing. In the bucket of an element, the members of the component with the most of them don't meet each
    other; so a hot bucket costs its other members times its size.
    """
    flat = sets.join(texts.select("key"), "key", "left_semi").select("key", F.explode("words").alias("w"))
    count = flat.groupBy("w").agg(F.count("*").alias("sets")).where("sets > 1")
    per = flat.join(count, "w").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sets", "w"))).alias("x"))
    first = F.slice("x", F.lit(1), F.greatest(F.lit(0), F.size("x") - overlap.least(F.col("n")) + 1).cast("int"))
    placed = texts.join(per, "key").select("key", "comp", "n", F.size("x").alias("shared"), F.posexplode(first).alias("i", "e"))
    placed = materialize(placed.select(F.col("e.w").alias("w"), "key", "comp", "n", (F.col("n") - F.col("shared") + F.col("i")).alias("place")), "prefixes")
    of = placed.groupBy("w", "comp").agg(F.count("*").alias("c")).groupBy("w").agg(F.max_by("comp", "c").alias("top"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all")
    own = placed.join(of.select("w", "top"), "w").where("comp <> top")
    other = placed.select("w", F.col("key").alias("leader"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("place").alias("there"))
    n, m = F.col("n"), F.col("m")
    room = lambda spare: F.least(n - F.col("place"), m - F.col("there")) + spare >= overlap.pair(n, m)
    met = own.join(other, "w").where((F.col("comp") != F.col("other")) & ((F.col("other") == F.col("top")) | (F.col("key") < F.col("leader"))) & (n >= overlap.least(m)) & (m >= overlap.least(n)) & room(F.lit(0)))
    # A pair may meet in buckets that differ in ``top``, so it may come in either order.
    one = met.select(F.least("key", "leader").alias("key"), F.greatest("key", "leader").alias("leader"), *(F.when(F.col("key") < F.col("leader"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("n", "m"), ("m", "n"), ("place", "there"), ("there", "place"))))
    seen = one.groupBy("key", "n", "leader", "m").agg(F.count("*").alias("c"), F.max("place").alias("place"), F.max("there").alias("there"))
    return materialize(seen.where(room(F.col("c") - 1)).select("key", "n", "leader", "m"), "pairs")


def similar_roots(groups: DataFrame, sets: DataFrame, overlap: Overlap, exact: bool = True) -> DataFrame | None:
    """``node, root``: components of the sets that have the overlap; None without a link.

    ``groups`` (``bucket, key, n, degree``) names candidates, ``sets`` (``key, words``) the sets. Every member meets the member of
    its group with the largest degree; all members of groups that are not one component then meet by ``rare_pairs``, which
    misses none. Without ``exact``, only the first step is done: its cost follows the members, however loose a group is.
    """
    best = groups.groupBy("bucket").agg(F.max(F.struct("degree", F.col("key").alias("leader"), F.col("n").alias("m"))).alias("x"))
    n, m = F.col("n"), F.col("m")
    led = groups.join(best, "bucket").select("key", "n", "x.leader", "x.m").where((F.col("key") != F.col("leader")) & (n >= overlap.least(m)) & (m >= overlap.least(n)))
    links = verified(materialize(led.distinct(), "pairs"), sets, overlap)
    roots = None if links.isEmpty() else materialize(resolve_components(links), "roots")
    if not exact:
        return roots
    named = groups.withColumn("comp", F.col("key"))
    if roots is not None:
        named = groups.join(roots, groups.key == roots.node, "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("comp"))
    named = materialize(named, "named")
    split = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    texts = materialize(named.join(split, "bucket", "left_semi").select("key", "comp", "n").distinct(), "open")
    more = verified(rare_pairs(texts, sets, overlap), sets, overlap)
    discard(named, texts)
    if more.isEmpty():
        return roots
    return materialize(resolve_components(links.unionByName(more)), "roots")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bits: int = MAX_BITS) -> DataFrame:
    """Documents of ``docs``, all columns, that are the smallest doc_id of their group of near copies.

    Texts link if their sets of word shingles (ASCII-lowered; fewer words: the whole sequence) have a Jaccard
    similarity of ``similarity`` or more; groups are the components of the links. Texts without words, null
    ones too, are copies of each other. Rows that repeat a kept doc_id are kept once. Rows without a
    doc_id stay as they are and take no part. No rows: no rows.
    """
    named = docs.where("doc_id is not null")
    signed = _rows(named, "doc_id").mapInArrow(_signatures(shingle), _SIGNATURE)
    texts = materialize(
        signed.groupBy("key").agg(F.min(F.struct("doc_id", "n", "fp", "bands")).alias("x")).select("key", "x.*"), "texts"
    )
    groups = candidate_groups(texts, bits)
    groups = materialize(groups, "candidates")
    wanted = texts.join(groups.select("key").distinct(), "key", "left_semi").select("doc_id").distinct()
    sets = _rows(named.join(wanted, "doc_id", "left_semi")).mapInArrow(_sets(shingle), "key bigint, words array<bigint>")
    sets = materialize(sets.groupBy("key").agg(F.first("words").alias("words")), "sets")
    low = texts.select("key", "doc_id")
    roots = similar_roots(groups, sets, Overlap(similarity))
    if roots is not None:
        low = low.join(roots, low.key == roots.node, "left").select(F.coalesce("root", "key").alias("key"), "doc_id")
    kept = materialize(low.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "kept")
    discard(texts, groups, sets, *([] if roots is None else [roots]))
    return named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where("doc_id is null"))
