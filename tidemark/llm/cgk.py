"""CGK random walks: an edit embedding whose Hamming distance follows the edit distance.

A walk over a text reads one byte a step and moves on by a shared random bit of (step, byte). Texts walk
in lockstep as NumPy vectors, longest first, so short texts leave early.
"""

from __future__ import annotations

import numpy as np

PERIOD = 16384
PAD = 0xFF  # never in UTF-8; the walk stays on it


def moves(seed: int, period: int = PERIOD) -> np.ndarray:
    """Random bits of (step, byte); the pad never moves."""
    r = np.random.default_rng(seed).integers(0, 2, (period, 256), np.uint8)
    r[:, PAD] = 0
    return r


def records(slots: int, seed: int, limit: int = 1 << 40) -> dict[int, list[int]]:
    """step -> slots whose sample moves there.

    Slot k samples, of a walk of m steps, the last record of a random sequence up to m. That is a uniform
    step, and two walks share it with the chance of their lengths' ratio.
    """
    rng, out = np.random.default_rng(seed), {}
    for k in range(slots):
        step = 1
        while step < limit:
            out.setdefault(step, []).append(k)
            step = int(step / max(1e-9, rng.random())) + 1
    return out


def sampled_walks(texts: list[bytes], move: np.ndarray, sample: dict[int, list[int]], slots: int) -> np.ndarray:
    """Bytes at the sampled steps, (texts, slots). A text of n bytes walks 2 n + 1 steps."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(texts[i] + bytes([PAD]) for i in order), np.uint8)
    steps = 2 * size[order] + 1
    pos = np.cumsum(size[order] + 1) - size[order] - 1
    out, a, period = np.full((slots, len(texts)), PAD, np.uint8), len(texts), len(move)
    for j in range(1, int(steps[0]) + 1 if len(texts) else 0):
        if steps[a - 1] < j:
            a = int(np.searchsorted(-steps, -j, side="right"))
        p = pos[:a]
        c = flat[p]
        if j in sample:
            out[sample[j], :a] = c
        p += move[j % period][c]
    back = np.empty_like(out)
    back[:, order] = out
    return back.T
