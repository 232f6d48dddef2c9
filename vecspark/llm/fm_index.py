"""An FM-index over a sequence of small integers: suffix array, wavelet matrix of its BWT, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol of s must be its only 0."""
    n, k = len(s), 1
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        new = np.empty(n, np.int64)
        new[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, k = new, 2 * k
        if rank[sa[-1]] == n - 1 or k >= n:
            return sa


class WaveletMatrix:
    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (s >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((b, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[one == 0], s[one == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        lo, hi = np.zeros_like(i), i
        for b, ones, zeros in self.levels:
            bit = ((symbol >> b) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol, lo, at = np.zeros_like(i), np.zeros_like(i), i
        for b, ones, zeros in self.levels:
            bit = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol | (bit.astype(np.int64) << b)
            lo1, at1 = ones[lo], ones[at]
            lo, at = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + at1, at - at1)
        return symbol, at - lo


class FMIndex:
    """s: non-negative symbols, without 0; SAMPLE text positions apart the suffix positions are kept."""

    SAMPLE = 8

    def __init__(self, s: np.ndarray):
        s = np.concatenate([s, [0]]).astype(np.int64)
        sa = suffix_array(s)
        self.n, top = len(s), int(s.max())
        self.tree = WaveletMatrix(s[sa - 1], max(1, top.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.sampled = np.where(sa % self.SAMPLE == 0, sa, -1)
        self.top = top

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns (rows, right-padded) at once: their suffix-array intervals [lo, hi)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, lengths[on] - 1 - step]
            known = (c > 0) & (c <= self.top)
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on], hi[on] = self.before[c] + self.tree.rank(c, lo[on]), self.before[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back through the BWT to the next sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            got = self.sampled[at[todo]]
            done = got >= 0
            out[todo[done]] = got[done] + steps[todo[done]]
            todo = todo[~done]
            c, r = self.tree.access_rank(at[todo])
            at[todo] = self.before[c] + r
            steps[todo] += 1
        return out
