"""Quality classifier: Bradley-Terry pairwise ranking on text features.

Every preference pair (a document labelled 1 beats one labelled 0) of the training labels counts in the logistic loss on feature
differences that trains a linear score. The pairs are never listed: the loss of two scores depends on their distance alone, so
sums over all pairs come from each class's scores, as Chebyshev series of cells of the score line (``_spread``). A step of the fit costs two passes
over the labelled rows; what comes to the driver follows the range of the scores, not the rows. The zero point is
the quantile of all training scores that the share of label 0 marks, so ``score = sigmoid(w.x - threshold)`` passes 0.5 exactly
above that quantile. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

#: Width of a cell of the score line and terms of its series. The logistic curve's poles are at a distance of pi, so the error of the
#: series falls by 3.4 with each term: 28 reach the precision of doubles.
CELL, TERMS = 4.0, 28
#: Up to so many labelled ids are sent to all tasks, which then read no signals of other texts.
LOOKUP = 100_000

_CLASS = np.zeros((256, 9))
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#$%&*", b".,;:?", b"<>{}[]=/\\_~^@+\"", range(128, 256))):
    _CLASS[list(_set), _i] = 1


def features(text: bytes) -> np.ndarray:
    """Signals of one whole text; all are bounded or logarithmic."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / size
    count = Counter(words)
    top = count.most_common(1)[0][1] if count else 0
    upper = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in count.items() if w[-1:] in b"!#$%&*|")
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    longest = max(map(len, words), default=0)
    line_count = Counter(lines)
    repeated = sum(c for c in line_count.values() if c > 1) / max(1, len(lines))
    base = np.array([*np.sqrt(shares), np.log1p(n), np.log1p(size / n), len(count) / n ** 0.8, top / n, upper / n, odd / n, pairs, np.log1p(longest), repeated, len(line_count) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))])
    spikes = np.array([odd / n, upper / n, top / n, repeated, shares[4]])
    return np.concatenate([base, spikes > 0.02, spikes > 0.1, spikes > 0.3, [n < 5, n < 20, pairs < 0.5]])


@dataclass
class Ranker:
    """A fitted model: ``score(x) = sigmoid((x - mean) / scale . weights - threshold)``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(axis=-1)  # row by row: the same in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -35, 35)))


def zero_point(raw: DataFrame, rank: int, bins: int = 1024) -> float:
    """Halfway between the ``rank``-th smallest value of the column ``raw`` and the next, by counts in ever finer bins."""
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    left = rank
    while low < high:
        at = F.least(F.floor((F.col("raw") - low) / (high - low) * bins), F.lit(bins - 1))
        for _, n, least, most in sorted(raw.where(F.col("raw").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*"), F.min("raw"), F.max("raw")).collect()):
            if left <= n:
                low, high = least, most
                break
            left -= n
    upto, following = raw.agg(F.sum((F.col("raw") <= low).cast("bigint")), F.min(F.when(F.col("raw") > low, F.col("raw")))).first()
    return low if upto > rank or following is None else (low + following) / 2


_X = np.cos((2 * np.arange(TERMS) + 1) * np.pi / (2 * TERMS))
#: (nodes of a cell, terms): what stands at the nodes for rows whose sums of Chebyshev polynomials are given.
_AT = np.cos(np.arange(TERMS) * np.arccos(_X)[:, None]) * 2 / TERMS
_AT[:, 0] /= 2


def _spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each score, and (rows, terms) Chebyshev polynomials of its place in the cell."""
    cell = np.floor(s / CELL)
    place = np.arccos(np.clip(2 * (s / CELL - cell) - 1, -1, 1))
    return cell.astype(np.int64), np.cos(np.arange(TERMS) * place[:, None])


def _blocks(rows: DataFrame, part, height: int) -> dict[int, np.ndarray]:
    """key -> (height, 1 + signals): the sums of the blocks that ``part(quality, x)`` gives for the rows ``quality, x``."""
    width = len(features(b"")) + 1
    names = [f"c{i}" for i in range(width)]

    def run(batches):
        total = {}
        for b in batches:
            if b.num_rows:
                for key, block in part(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)):
                    total[key] = total[key] + block if key in total else block
        for key, block in total.items():
            slot = pa.array(np.arange(height, dtype=np.int64) + key * height)
            yield pa.RecordBatch.from_arrays([slot, *(pa.array(c) for c in np.ascontiguousarray(block.T))], ["slot", *names])

    sums = rows.select("quality", "x").mapInArrow(run, "slot bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names))
    out: dict[int, np.ndarray] = {}
    for slot, *v in sums.collect():
        out.setdefault(slot // height, np.zeros((height, width)))[slot % height] = v
    return out


def _moments(y: np.ndarray, x: np.ndarray):
    for k in (0, 1):
        of = x[y == k]
        yield k, np.vstack([np.append(len(of), of.sum(0)), np.append(0, (of * of).sum(0))])


def _series(model: Ranker):
    """For ``_blocks``: of each cell and class (key: cell * 2 + class), sums of the polynomials times 1 and the scaled signals."""

    def part(y, x):
        cell, t = _spread(model.raw(x))
        z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
        for key in np.unique(cell * 2 + y):
            at = cell * 2 + y == key
            yield int(key), t[at].T @ z[at]

    return part


def _curvature(model: Ranker, bend: dict[int, np.ndarray]):
    """For ``_blocks``: the products of the scaled signals, weighted by the series ``bend`` of each row's cell and class."""

    def part(y, x):
        cell, t = _spread(model.raw(x))
        z = (x - model.mean) / model.scale
        weight = (t * np.array([bend[k] for k in (cell * 2 + y).tolist()])).sum(axis=1)
        yield 0, np.column_stack([np.zeros(z.shape[1]), (z * weight[:, None]).T @ z])

    return part


def _all_pairs(cells: dict[int, np.ndarray]):
    """Over all pairs of the classes, from ``_series``: the loss, its gradient, the mixed products of the curvature, and the series of its weights."""
    t = {k: (k // 2 + (_X + 1) / 2) * CELL for k in cells}
    at = {k: _AT @ block for k, block in cells.items()}
    bad, good = ([k for k in sorted(cells) if k % 2 == c] for c in (0, 1))
    t0, at0 = np.concatenate([t[k] for k in bad]), np.vstack([at[k] for k in bad])
    width = at0.shape[1] - 1
    loss, slope, mixed, push, bend0, bend = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(len(t0)), np.zeros(len(t0)), {}
    for k in good:
        gap, of = t0 - t[k][:, None], at[k]
        p = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        curve = p * (1 - p)
        loss += of[:, 0] @ np.logaddexp(0, gap) @ at0[:, 0]
        slope -= (p @ at0[:, 0]) @ of[:, 1:]
        push += of[:, 0] @ p
        mixed += of[:, 1:].T @ (curve @ at0[:, 1:])
        bend[k] = _AT.T @ (curve @ at0[:, 0])
        bend0 += of[:, 0] @ curve
    bend |= {k: _AT.T @ x for k, x in zip(bad, bend0.reshape(-1, TERMS), strict=True)}
    return loss, slope + push @ at0[:, 1:], mixed, bend


def fit_pairs(rows: DataFrame, ridge: float = 1e-3, steps: int = 40) -> Ranker:
    """Newton steps on the mean logistic loss over all pairs of the rows ``quality, x``; threshold 0. Without both classes: all scores 0.5."""
    width = len(features(b""))
    sums = _blocks(rows, _moments, 2)
    n = [sums[k][0, 0] if k in sums else 0 for k in (0, 1)]
    if not min(n):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, square = ((sums[0] + sums[1]) / sum(n))[:, 1:]
    # Rounding hides the order in which tasks' sums were added up.
    mean, scale = np.round(mean, 9), np.round(np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-3), 9)
    pairs = n[0] * n[1]

    def value(w):
        loss, slope, mixed, bend = _all_pairs(_blocks(rows, _series(Ranker(mean, scale, w, 0.0)), TERMS))
        return loss / pairs + ridge / 2 * w @ w, slope / pairs + ridge * w, mixed, bend

    w = np.zeros(width)
    loss, slope, mixed, bend = value(w)
    for _ in range(steps):
        own = _blocks(rows, _curvature(Ranker(mean, scale, w, 0.0), bend), width)[0][:, 1:]
        step = -np.linalg.solve((own - mixed - mixed.T) / pairs + ridge * np.eye(width), slope)
        if np.abs(step).max() < 1e-6:
            w = w + step
            break
        got = value(w + step)
        while got[0] > loss + 1e-12 and np.abs(step).max() > 1e-9:  # too far: go half the way
            step = step / 2
            got = value(w + step)
        w, (loss, slope, mixed, bend) = w + step, got
    return Ranker(mean, scale, np.round(w, 9), 0.0)


def training_labels(labels: DataFrame, trainable: Column) -> DataFrame:
    """``doc_id, quality`` of the training rows; null labels never count. A doc_id with labels of both kinds is left out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & trainable)
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")


def training_rows(docs: DataFrame, one: DataFrame) -> DataFrame:
    """``doc_id, quality, x`` (signals) of every id of ``training_labels`` that has a document; of rows that share an id, the text with the smallest hash."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if one.count() <= LOOKUP:
        rows = rows.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            x = [features(t or b"") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "x"])

    signals = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id bigint, h bigint, x array<double>")
    known = signals.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("of")).join(one, "doc_id")
    return known.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("of.x").alias("x"))


def labelled_sample(one: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of each class of ``training_labels`` or ``training_rows``."""
    part = [one.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    return part[0].unionByName(part[1])


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, bound: int | None = None) -> Ranker:
    """Fit on all pairs of all labelled documents; with ``bound``, the weights on at most so many rows of each class.

    The threshold counts all labelled documents, whatever the bound.
    """
    rows = materialize(training_rows(docs, training_labels(labels, trainable)), "training")
    used = rows if bound is None else materialize(labelled_sample(rows, bound), "sample")
    model = fit_pairs(used)
    if model.weights.any():

        def run(batches):
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(x), pa.float64())], ["raw"])

        raw = materialize(rows.select("x").mapInArrow(run, "raw double"), "raw")
        model.threshold = zero_point(raw, rows.where("quality = 0").count())
        discard(raw)
    discard(rows, *([] if bound is None else [used]))
    return model


def score(docs: DataFrame, model: Ranker, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``quality_score`` of every row. Null text counts as empty.

    Rows that repeat are all scored; a column of ``docs`` named quality_score is replaced; empty input gives empty output.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "quality_score"] if keep is None else keep
    out = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    schema = docs.select(*keep).schema

    def run(batches):
        for b in batches:
            x = np.array([features(t or b"") for t in b.column(len(keep)).to_pylist()]).reshape(b.num_rows, -1)
            y = model.score(x) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(y, pa.float64())], [*keep, "quality_score"])

    return out.mapInArrow(run, schema.add("quality_score", "double"))
