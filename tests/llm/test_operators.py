"""Corpus operators against brute force on a small fixture with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    decontaminate, edit_fingerprints, extendible_shards, near_copies, pii_spans, ppm_scores, quality_ranker, queries, simhash_dedup,
    substring_dedup, temperature_mix, token_counts,
)
from tidemark.llm.common import HashMemo

SF = "/root/testdata/sf0.001"
#: Clashing names: operators use some of these inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, depth int, fp bigint, tokens bigint, key string, quality int, shard_bytes bigint, quality_score double"
COPY = " ".join(f"word{i}" for i in range(70))


def fixture_rows():
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("re", "lo", "ñu", "ta", "KE") for b in ("ma", "ti", "so", "漢")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) for _ in range(40)]
    texts += ["", None, " \t\n", "one", COPY, COPY, "Start " + COPY + " end", COPY.upper(), "x" * 30_000, "ab " * 20_000, "mail me: a.b@c.org or +1 (555) 123-4567, 10.0.0.1"]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", None, 1, 2, 3, "k", 4, 5, 0.5) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], None, None, None, None, None, None, None, None, None, None), (4, "another text under a used id", *[None] * 10), (None, "no id but words here", *[None] * 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ROWS = [(r[0], (r[1] or "").encode()) for r in fixture_rows()]


def test_substring_dedup(docs, empty):
    first = {}
    for i, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = Counter()
    for i, t in ROWS:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    got = substring_dedup.dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert sum(r.n_removed for r in got) >= 140
    assert substring_dedup.dedup_substrings(empty).collect() == []


def test_window_entries_do_not_grow_with_the_ranges():
    """What a chunk sends follows its windows, whatever the number of hash ranges; ids stay those of the entries."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(7 * i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(300)).encode()) for i in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "text"])
    sent = {}
    for ranges in (32, 6000):
        out = pa.Table.from_batches(list(substring_dedup._mapper(13, ranges)([batch])))
        sent[ranges] = sum(len(x) for c in ("hashes", "docs") for x in out.column(c).to_pylist() if x)
    assert sent[6000] == sent[32] == 16 * 800 * 288


def test_ids_are_dealt_as_spark_does(spark):
    ids = [0, 1, -1, 42, 2**62, -(2**63), 10**12]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x bigint").select(F.xxhash64("x")).collect()]
    assert substring_dedup.spark_hash(np.array(ids, np.int64)).tolist() == got


def test_ppm_scores(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {}
    for r in ppm_scores.score_documents(docs, held, order=3).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*t.lower().split(), b" "]) for i, t in ROWS]
    c = Counter(w for i, t in toks if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    tabs = [defaultdict(Counter) for _ in range(4)]
    for i, t in toks:
        if not out(i):
            s = b"\xfe" * 3 + b" ".join(t[:-1]) + b"\xff"
            for j in range(3, len(s)):
                for k in range(4):
                    tabs[k][s[j - k : j]][s[j]] += 1

    def logp(ctx, sym):
        ex, r = set(), 0.0
        for k in range(3, -1, -1):
            t = tabs[k].get(ctx[3 - k :])
            if not t:
                ex = set()
                continue
            live = {a: b for a, b in t.items() if a not in ex}
            if sym in live:
                return r + math.log10((2 * live[sym] - 1) / (2 * sum(live.values())))
            if live:
                r += math.log10(len(live) / (2 * sum(live.values())))
            ex = set(t)
        return r - math.log10(max(1, 256 - len(ex)))

    for i, t in toks:
        if len(t) > 500 or len(got[i]) > 1:
            continue
        r = got[i][0]
        assert r.train_tokens == n and r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.held_out == out(i)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        s = b"\xfe" * 3 + b" ".join(t[:-1]) + b"\xff"
        assert r.score == pytest.approx(sum(logp(s[j - 3 : j], s[j]) for j in range(3, len(s))), rel=1e-5)
    assert ppm_scores.score_documents(empty, held).collect() == []


def fingerprint(t):
    w = t.lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)) if hs else 0


def closure(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def test_simhash(docs, empty):
    fps = [(i, fingerprint(t)) for i, t in ROWS]
    roots = closure(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(low.get(roots[f], i), i)
    got = simhash_dedup.components(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == Counter((i, f, low.get(roots[f])) for i, f in fps)
    kept = simhash_dedup.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) - {None} == {low[r] for r in low}
    assert simhash_dedup.components(empty).collect() == [] and simhash_dedup.one_per_group(empty).collect() == []


def test_vantage_points_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, np.uint64)
    dense = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:5] for i, j in rng.integers(0, 63, (150, 2))]
    fps = sorted({*map(int, base), *dense})
    got = simhash_dedup.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 2, leaf=64).collect()
    want = {a: r for a, r in closure(fps, lambda a, b: (a ^ b).bit_count() <= 2).items()}
    sizes = Counter(want.values())
    assert {(r.node, r.root) for r in got} == {(a, r) for a, r in want.items() if sizes[r] > 1}


def edited_copies(rng, words, base, at):
    out = []
    for k in at:
        w = list(base)
        for i in rng.sample(range(len(w)), k):
            w[i] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_near_copies(spark, docs, empty):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for size in (40, 120, 300, 900):
        base = [rng.choice(words) for _ in range(size)]
        texts += [" ".join(base).upper(), *edited_copies(rng, words, base, [0, 1, 1, 2, 3, 4, 6, 8, size // 30, size // 10])]
    texts += ["one two", "One  two", "one two three", "", None, " "]
    extra = spark.createDataFrame([(1000 + i, t, *[None] * 10) for i, t in enumerate(texts)], SCHEMA)
    every = docs.unionByName(extra)
    rows = {(i, t) for i, t in [*ROWS, *((1000 + i, (t or "").encode()) for i, t in enumerate(texts))] if i is not None}

    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r: shingles(r[1]) for r in rows}
    nodes = sorted(set(sets.values()), key=lambda s: min(i for (i, _), x in sets.items() if x == s))
    roots = closure(list(range(len(nodes))), lambda a, b: len(nodes[a] & nodes[b]) >= 0.8 * len(nodes[a] | nodes[b]))
    low = {}
    for (i, _), s in sets.items():
        r = roots[nodes.index(s)]
        low[r] = min(low.get(r, i), i)
    kept = near_copies.one_per_group(every)
    assert kept.columns == every.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) - {None} == set(low.values())
    assert near_copies.one_per_group(empty).collect() == []


def test_near_copies_in_a_hot_group(spark):
    """Copies of one text, each similar to it and most not to each other, end in one group."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(base), *edited_copies(rng, words, base, [3] * 300), *(" ".join(rng.choice(words) for _ in range(50)) for _ in range(50))]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert near_copies.one_per_group(docs).count() == 51


def test_loose_groups_make_few_pairs(spark):
    """Copies of a text that is not among them, most under the similarity to each other: few pairs go on to be verified."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = edited_copies(rng, words, base, [rng.randrange(1, 30) for _ in range(300)])
    sets = [frozenset(near_copies.shingle_hashes(t.encode(), 5, HashMemo()).tolist()) for t in texts]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    frame = spark.createDataFrame([(i, i, len(x)) for i, x in enumerate(sets)], "key bigint, comp bigint, n int")
    words = spark.createDataFrame([(i, [x - 2**63 for x in s]) for i, s in enumerate(sets)], "key bigint, words array<bigint>")
    pairs = [(r.key, r.leader) for r in near_copies.rare_pairs(frame, words, near_copies.Overlap(0.8)).collect()]
    linked = {(a, b) for a in range(300) for b in range(a + 1, 300) if similar(a, b)}
    assert len(pairs) == len(set(pairs)) and {(min(p), max(p)) for p in pairs} >= linked and len(linked) > 30
    assert len(pairs) < 300 * 299 / 2 / 4, len(pairs)


def test_near_copies_in_chains_through_a_hub(spark):
    """A copy of a hub's copy that is not similar to the hub is still linked to its parent, whether or not they share a band."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    first = edited_copies(rng, words, base, [1] * 60)
    second = [t for f in first for t in edited_copies(rng, words, f.split(), [4])]
    texts = [" ".join(base), *first, *second]
    sets = [frozenset(near_copies.shingle_hashes(t.encode(), 5, HashMemo()).tolist()) for t in texts]
    roots = closure(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(len(sets[0] & s) < 0.8 * len(sets[0] | s) for s in sets) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.one_per_group(docs).collect()) == sorted(set(roots.values()))


def test_quality(spark, docs, empty):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_ranker.fit(d, lab, ~held)
    r = quality_ranker.score(d, model, ["doc_id"]).join(lab, "doc_id").where(held).toPandas()
    assert ((r.quality_score >= 0.5) == (r.quality == 1)).mean() > 0.9
    x = quality_ranker.score(docs, model).collect()
    assert len(x) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in x)
    assert quality_ranker.score(empty, model).collect() == []
    none = quality_ranker.fit(docs, lab.limit(0), F.lit(True))
    assert {r.quality_score for r in quality_ranker.score(docs, none).collect()} == {0.5}


def test_quality_threshold_counts_all_labels(spark):
    """The share that is rejected does not follow the bound of the sample."""
    rng = random.Random(3)
    d = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 4 for _ in range(40)) + " !!! ###" * (rng.randrange(3, 40) if i % 8 == 0 else rng.randrange(0, 8))) for i in range(1600)], "doc_id bigint, text string")
    lab = d.select("doc_id", F.when(F.col("doc_id") % 8 == 0, 0).otherwise(1).alias("quality"))
    for bound in (100, 8000):
        model = quality_ranker.fit(d, lab, F.lit(True), bound)
        low = quality_ranker.score(d, model, ["doc_id"]).where("quality_score < 0.5").count()
        assert abs(low / 1600 - 1 / 8) < 0.03


def test_quality_fits_all_pairs(spark):
    """Weights and threshold against brute force on every pair and every labelled row."""
    rng = random.Random(8)
    text = lambda bad: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 6) for _ in range(rng.randrange(5, 60))) + " !!! ##" * rng.randrange(0, 9 if bad else 5)
    rows = [(i, text(i % 3 == 0), 0 if i % 3 == 0 else 1) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(3)
    model = quality_ranker.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"), F.lit(True))
    x, y = np.array([quality_ranker.features(t.encode()) for _, t, _ in rows]), np.array([q for *_, q in rows])
    assert model.mean == pytest.approx(x.mean(0), abs=1e-8) and model.scale == pytest.approx(np.maximum(x.std(0), 1e-3), abs=1e-8)
    z = (x - model.mean) / model.scale
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(pairs @ w))
        w += np.linalg.solve((pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + 1e-3 * np.eye(len(w)), p @ pairs / len(pairs) - 1e-3 * w)
    assert model.weights == pytest.approx(w, abs=1e-6)
    s = np.sort(z @ w)
    assert model.threshold == pytest.approx((s[79] + s[80]) / 2, abs=1e-5)


def test_quality_zero_point(spark):
    rng = random.Random(9)
    for values in ([rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9) for _ in range(500)], [float(rng.randrange(6)) for _ in range(500)], [1.0] * 9):
        raw, s = spark.createDataFrame([(v,) for v in values], "raw double"), sorted(values)
        for rank in (1, len(s) // 3, len(s) - 1):
            assert quality_ranker.zero_point(raw, rank, 16) == (s[rank - 1] + s[rank]) / 2


def test_shards(docs, empty):
    out = extendible_shards.assign_shards(docs, limit=3000).collect()
    assert len(out) == len(ROWS)
    size, n = Counter(), Counter()
    for r in out:
        size[r.shard] += len((r.text or "").encode())
        n[r.shard] += 1
    assert all(size[s] <= 3000 or n[s] == 1 for s in size)
    assert all((r.shard_bytes, r.shard_rows) == (size[r.shard], n[r.shard]) for r in out)
    for s in size:
        assert not any(s != t and t.startswith(s) for t in size)  # prefix-free
        if s:
            assert sum(size[t] for t in size if t.startswith(s[:-1])) > 3000  # no split without need
    same = docs.select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("y" * 100).alias("text"))
    assert all(r.shard_bytes <= 1000 for r in extendible_shards.assign_shards(same, limit=1000).collect())
    assert extendible_shards.assign_shards(empty).collect() == []


def edited(texts):
    rows = sorted(texts, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        s, n = t.decode(), len(t.decode()) // 4
        yield i, len(s), hashlib.sha256((s[: len(s) - n] + f.decode()[:n]).encode()).hexdigest()


def test_fingerprints(docs, empty):
    got = edit_fingerprints.compare_with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(edited(ROWS))
    by = {r.doc_id: r for r in got}
    assert by[44].fingerprint == by[45].fingerprint != by[47].fingerprint
    assert min(r.near_edited for r in got) > 0.55
    one = edit_fingerprints.fingerprint(docs)
    assert {r.doc_id: r.fingerprint for r in one.collect()}[44] == by[44].fingerprint
    groups = {r.doc_id: r.group_id for r in edit_fingerprints.near_groups(one).collect()}
    assert groups[44] == groups[45] == 44 and groups[0] == 0
    assert edit_fingerprints.compare_with_edits(empty).collect() == []


def test_near_groups_of_unequal_fingerprints(spark):
    """Chains of near fingerprints whose bands are also shared by unrelated ones, against brute force on whole fingerprints."""
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        f = [rng.randrange(2) for _ in range(128)]  # two values: unrelated ones share bands too
        for _ in range(5):
            rows.append(bytes(f))
            for at in rng.sample(range(128), 20):
                f[at] = rng.randrange(2, 200)
    rng.shuffle(rows)
    roots = closure(list(range(len(rows))), lambda a, b: sum(map(int.__eq__, rows[a], rows[b])) >= 0.8 * 128)
    prints = spark.createDataFrame([(i, f.hex()) for i, f in enumerate(rows)], "doc_id bigint, fingerprint string")
    assert {r.doc_id: r.group_id for r in edit_fingerprints.near_groups(prints).collect()} == roots


def near_prints(rng):
    """Pairs of fingerprints that just agree in 103 of 128 slots, one different slot in every band of 5 but one; chains; a dense hub; strangers."""
    rows = []
    for _ in range(30):
        f = [rng.randrange(256) for _ in range(128)]
        rows.append(bytes(f))
        for at in rng.sample([128 * b // 26 + rng.randrange(4) for b in range(26)], 25):
            f[at] = (f[at] + 1) % 256
        rows.append(bytes(f))
    hub = [rng.randrange(256) for _ in range(128)]
    for i in range(150):
        f = list(hub)
        for at in rng.sample(range(128), 5 if i < 50 else 18):
            f[at] = rng.randrange(256)
        rows.append(bytes(f))
    rows += [bytes(rng.randrange(256) for _ in range(128)) for _ in range(100)]
    rng.shuffle(rows)
    return rows, closure(list(range(len(rows))), lambda a, b: sum(map(int.__eq__, rows[a], rows[b])) >= 0.8 * 128)


def test_near_groups_lose_no_link(spark, tmp_path, monkeypatch):
    """The query's groups are those of brute force over all pairs of fingerprints, also where a bucket is cut into cells."""
    rows, roots = near_prints(random.Random(14))
    prints = spark.createDataFrame([(i, f.hex()) for i, f in enumerate(rows)], "doc_id bigint, fingerprint string")
    monkeypatch.setattr(edit_fingerprints, "compare_with_edits", lambda docs: prints)
    spark.createDataFrame([(0, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.group_id for r in queries.op6_edit_fingerprints(spark, str(tmp_path)).collect()} == roots


def test_near_groups_in_cells(spark):
    rows, roots = near_prints(random.Random(15))
    prints = spark.createDataFrame([(i, f.hex()) for i, f in enumerate(rows)], "doc_id bigint, fingerprint string")
    assert {r.doc_id: r.group_id for r in edit_fingerprints.near_groups(prints, block=6).collect()} == roots


def test_near_groups_find_edited_texts(spark):
    """Texts whose edit similarity is high are grouped, unrelated ones are not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, family = [], {}
    for f in range(40):
        base = [word() for _ in range(150)]
        for _ in range(3):
            w = list(base)
            for at in rng.sample(range(150), rng.randrange(0, 2)):
                w[at] = word()
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in edit_fingerprints.near_groups(edit_fingerprints.fingerprint(docs)).collect()}
    assert all(family[g] == family[i] for i, g in got.items())
    prints = {r.doc_id: bytes.fromhex(r.fingerprint) for r in edit_fingerprints.fingerprint(docs).collect()}
    near = [(a, b) for a in prints for b in prints if a < b and sum(x == y for x, y in zip(prints[a], prints[b], strict=True)) >= 0.8 * 128]
    assert near and all(got[a] == got[b] for a, b in near)
    led = {r.doc_id: r.group_id for r in edit_fingerprints.near_groups(edit_fingerprints.fingerprint(docs), exact=False).collect()}
    assert sum(led[a] == led[b] for a, b in near) >= 0.95 * len(near) and all(family[g] == family[i] for i, g in led.items())


def test_decontamination(spark, docs, empty):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(40))
    near = item.split()
    near[7], near[20], near[33] = "changed", "words", "here"
    far = item.split()
    rng.shuffle(far)
    extra = spark.createDataFrame([(900, f"before {item.upper()} after"), (901, "x " * 50 + " ".join(near)), (902, " ".join(far)), (903, " ".join(item.split()[:15])), (904, COPY), (905, "it came before shade fell"), (906, "abefore shade"), (907, "before shades")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (4, ""), (None, COPY), (5, item), (6, "Before  Shade")], "item_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(every, bench).collect()}
    assert set(got) == {(900, 1), (901, 1), (900, 5), (901, 5), (905, 6)} and got[900, 1] == got[905, 6] == 0
    assert got[901, 1] == got[901, 5] <= 0.2 * len(item)
    assert decontaminate.clean(every, bench).count() == every.count() - 3
    odd = every.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("item_id", "level", "hash", "place", "items")))
    again = decontaminate.contaminated(odd.unionByName(odd), bench.withColumn("doc_id", F.lit(3)))
    assert {(r.doc_id, r.item_id): r.distance for r in again.collect()} == got
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def _words_replaced(rng, word, w):
    w = list(w)
    for i in rng.sample(range(len(w)), len(w) // 5):
        w[i] = word()
    return " ".join(w)


def _typos(rng, word, w):
    typo = lambda x: x[: (k := rng.randrange(len(x)))] + rng.choice("qrstuvwxyz") + x[k + 1 :]
    return " ".join(typo(x) if rng.random() < 0.4 else x for x in w)


def _letters_changed(rng, word, w):
    s = list(" ".join(w))
    for _ in range(len(s) // 5):
        at, kind = rng.randrange(len(s)), rng.random()
        s[at : at + (kind > 0.2)] = [rng.choice("qrstuvwxyz")] * (kind < 0.8)
    return "".join(s)


@pytest.mark.parametrize("change", [_words_replaced, _typos, _letters_changed])
def test_decontamination_finds_passages_near_the_bound(spark, change):
    """Items of 5 words and more, edited down to a similarity of 0.8, against brute force over all pairs."""
    rng, items, texts = random.Random(8), {}, {}
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10)))
    sizes = (5, 6, 8, 10, 15, 20, 30, 45)
    for i in range(240):
        w = [word() for _ in range(sizes[i % 8])]
        items[i] = " ".join(w)
        texts[i] = f"{word()} {change(rng, word, w)} " + " ".join(word() for _ in range(60))
    want = {i for i in items if decontaminate.substring_distance(items[i], texts[i], int(0.2 * len(items[i]))) is not None}
    got = decontaminate.contaminated(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id == r.item_id}
    assert len(want) > 100 and found <= want
    for k, n in enumerate(sizes):
        own = {i for i in want if i % 8 == k}
        assert len(found & own) >= 0.9 * len(own), (n, len(found & own), len(own))
    own = {i for i in want if sizes[i % 8] > 15}
    assert len(found & own) >= 0.97 * len(own), (len(found & own), len(own))


def test_substring_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(1)
    for _ in range(60):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))) for _ in range(2))
        assert decontaminate.substring_distance(p, t, 99) == plain(p, t)
    pairs = [tuple("".join(rng.choice("abñ漢") for _ in range(rng.randrange(1, 300))) for _ in range(2)) for _ in range(30)]
    assert decontaminate.substring_distances(pairs).tolist() == [plain(p, t) for p, t in pairs]


def test_mixing(docs, empty):
    plan = temperature_mix.mixing_plan(docs, max_repeats=3.0).toPandas()
    words = Counter()
    for r in fixture_rows():
        words[r[3] or ""] += len((r[1] or "").split())
    assert not plan.duplicated(["doc_id", "copy", "epoch"]).any()
    used, total = plan.groupby("source").tokens.sum(), sum(words.values())
    assert all(used[s] <= 3.01 * words[s] for s in used.index) and used.sum() <= total + len(words)
    for (_, epoch), g in plan.groupby(["source", "epoch"]):
        assert sorted(g.position) == list(range(1, len(g) + 1)) or epoch == plan[plan.source == g.source.iloc[0]].epoch.max()
    out = temperature_mix.mix(docs, max_repeats=3.0)
    assert out.columns == docs.columns and out.count() == len(plan)
    assert temperature_mix.mixing_plan(empty).collect() == [] and temperature_mix.mix(empty).collect() == []


def test_exponent(spark):
    tokens = [1000, 100, 10, 1]
    p = [t / sum(tokens) for t in tokens]
    shares = spark.createDataFrame([(math.log(x),) for x in p], "ln_p double")
    t = temperature_mix.bisect_exponent(shares, 0.9)
    w = [x**t for x in p]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(4), abs=1e-5)
    t = temperature_mix.bisect_exponent(shares, None, 5.0)
    assert max(x**t / sum(y**t for y in p) / x for x in p) == pytest.approx(5.0, abs=1e-4)


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    lib = Tokenizer.from_str(text)
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(800, "it's <|endoftext|>a  Σας é x\u0085y 'll"), (801, " <|startoftext|> ")], "doc_id bigint, text string"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False))) for r in odd.collect())
    cache = str(tmp_path / "cache")
    assert Counter(map(tuple, token_counts.count_tokens(odd, text, cache).collect())) == want
    stored = token_counts.read_cache(spark, cache).count()
    assert Counter(map(tuple, token_counts.count_tokens(odd, text, cache).collect())) == want
    assert token_counts.read_cache(spark, cache).count() == stored  # no miss the second time
    assert token_counts.count_tokens(empty, text).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * good
    return ",".join(out)


def test_pii(spark, docs, empty):
    rng = random.Random(2)
    odd = ["".join(rng.choice("a.@-+ 1245é0()") for _ in range(120)) for _ in range(60)] + ["4111 1111 1111 1111 4111-1111-1111-1112", "a@b.c_d@e.f x1.2.3.4.5.6.7.8 256.1.1.1", "9" * 20_000 + "a" * 20_000 + "1 " * 20_000]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 700)), "doc_id bigint, text string"))
    got = pii_spans.detect_pii(df).select("doc_id", pii_spans.joined(F.filter("spans", lambda x: x["base"])).alias("b"), pii_spans.joined(F.col("spans")).alias("s")).collect()
    assert Counter((r.doc_id, r.b) for r in got) == Counter((r.doc_id, base_spans(r.text or "")) for r in df.collect())
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)
    assert pii_spans.detect_pii(empty).collect() == []


def test_pii_added_spans(spark):
    """Spans that no base pattern has: spelled-out mail, plain phone numbers, 15-digit cards and long addresses."""
    rows = [(1, "write to jane [at] site [dot] org now"), (2, "call 555-123-4567 now"), (3, "card 378282246310005 paid"), (4, "host 2001:db8:0:1:2:3:4:5 up"), (5, "a@b.com (555) 123-4567"), (6, "+1 (555) 123-4567"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x"), "start": F.lit(3)})
    got = {r.doc_id: r.s for r in pii_spans.detect_pii(docs.unionByName(docs)).select("doc_id", pii_spans.joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: "email:9:33", 2: "phone:5:17", 3: "card:5:20", 4: "ip:5:25", 5: "email:0:7,phone:8:22", 6: "phone:0:17", 7: "", 8: ""}


def test_pii_in_long_texts(spark):
    """Time follows the length: a megabyte of addresses, and runs that nearly match."""
    rows = [(1, "10.1.2.3, " * 100_000), (2, "1." * 100_000), (3, "call 555 123 4567 or " * 5_000)]
    got = {r.doc_id: r.spans for r in pii_spans.detect_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [100_000, 25_000, 5_000]
    assert [(x.start, x.end) for x in got[1][-2:]] == [(999_980, 999_988), (999_990, 999_998)]
    assert (got[2][-1].start, got[2][-1].end) == (199_992, 199_999) and (got[3][-1].start, got[3][-1].end) == (104_984, 104_996)


def test_running_folds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-50, 50) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 10, 99, 100, 101, 1000))]
    df = spark.createDataFrame(rows, "i int, v array<int>").select("i", "v", pii_spans.running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("sum"), pii_spans.running(F.col("v"), F.lit(-99), lambda a, x: F.greatest(a, x)).alias("max"))
    for r in df.collect():
        assert r["sum"] == np.cumsum(r.v).tolist() and r["max"] == np.maximum.accumulate(np.array(r.v, int)).tolist()


def test_em_trusts_agreeing_labelers():
    counts = [("phone", (1, 1, 1, 1, 1), 50), ("phone", (2, 0, 0, 2, 0), 50), ("phone", (2, 1, 2, 1, 1), 5)]
    post = pii_spans.estimate(counts)
    assert post["phone", (1, 1, 1, 1, 1)] > 0.9 > 0.1 > post["phone", (2, 0, 0, 2, 0)] and post["phone", (2, 1, 2, 1, 1)] > 0.5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert Counter(map(tuple, got.values.tolist())) == Counter(map(tuple, want.values.tolist()))


def test_pipeline(spark):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "shard_bytes", "shard_rows"]
    items = {decontaminate.canonical(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = [decontaminate.canonical(r.text.encode()) for r in out.collect()]
    assert texts and not any(i in t for t in texts for i in items)
