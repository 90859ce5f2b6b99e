"""Hashed byte n-gram counts of whole texts, in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np

from horosphere.llm.shingles import runs

_MULT = np.uint32(0x9E3779B1)


def gram_counts(raw: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Yield (first row, counts[rows, 2**bits]) of the byte n-grams inside each row.

    Rows are taken in runs of bounded bytes, so the matrix stays small; a very
    long text is counted whole.
    """
    width = 1 << bits
    for lo, hi in runs(off, 1 << 18):
        o = off[lo:hi + 1] - off[lo]
        b = raw[off[lo]:off[hi]].astype(np.uint32)
        row = np.repeat(np.arange(hi - lo), np.diff(o))
        out = np.zeros((hi - lo) * width, np.int64)
        for n in sizes:
            m = len(b) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n))
            for j in range(n):
                h = (h * np.uint32(0x01000193)) ^ b[j:j + m]
            h = (h * _MULT) >> np.uint32(32 - bits)
            same = row[:m] == row[n - 1:]
            out += np.bincount(row[:m][same] * width + h[same], minlength=len(out))
        yield lo, out.reshape(hi - lo, width)


def to_sparse(counts: np.ndarray):
    """(list of column arrays, list of count arrays), one of each per row."""
    at = [np.flatnonzero(c) for c in counts]
    return at, [c[i] for c, i in zip(counts, at)]


class Adam:
    """Adam steps on a list of numpy arrays."""

    def __init__(self, params, lr=0.01):
        self.params, self.lr, self.t = params, lr, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.lr * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)
