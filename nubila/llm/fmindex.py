"""FM-index over word ids in NumPy: suffix order, wavelet matrix of the transform, sampled positions.

Symbol 0 ends the text and stands nowhere else.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all suffixes in order: one sort by as many symbols as 62 bits hold, then doubling among ties."""
    n = len(text)
    depth = max(1, 62 // bits)
    padded = np.concatenate((text.astype(np.int64), np.zeros(depth, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key <<= bits
        key |= padded[k : n + k]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    # the rank of a suffix: place of the first of its equals
    rank = np.empty(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    tied = ~new
    tied[:-1] |= ~new[1:]
    places = np.flatnonzero(tied)
    while len(places):
        at = order[places]
        after = at + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, second, head = at[by], second[by], rank[at][by]
        order[places] = at
        new = np.r_[True, (head[1:] != head[:-1]) | (second[1:] != second[:-1])]
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = places[tied]
        depth *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        self.n, self.bits = len(text), max(1, int(symbols - 1).bit_length())
        order = suffix_order(text, self.bits)
        last = text[order - 1]  # the symbol before each suffix, cyclically
        count = np.bincount(text, minlength=1 << self.bits)
        self.first = np.concatenate(([0], np.cumsum(count)))[:-1]
        self.levels = []
        x = last
        for level in range(self.bits - 1, -1, -1):
            one = (x >> level) & 1 == 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((level, ones, self.n - int(ones[-1])))
            x = np.concatenate((x[~one], x[one]))
        self.start = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, dtype=np.int64))
        kept = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.kept, self.samples = kept, order[kept].astype(np.int32)
        self.last = last.astype(np.int32)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        for level, ones, zeros in self.levels:
            r = ones[i]
            i = np.where((c >> level) & 1 == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands among the first i of the transform."""
        return self._down(c, i) - self.start[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many phrases of one length: (from, to) rows of each; equal where there is none."""
        m, length = phrases.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.arange(m)
        for t in range(length - 1, -1, -1):
            c = phrases[live, t]
            a = self.first[c] + self.rank(c, lo[live])
            b = self.first[c] + self.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        hi[hi < lo] = lo[hi < lo]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled one."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        go = np.flatnonzero(~self.kept[rows])
        while len(go):
            r = rows[go]
            c = self.last[r]
            rows[go] = self.first[c] + self.rank(c, r)
            steps[go] += 1
            go = go[~self.kept[rows[go]]]
        return self.samples[self.marks[rows]] + steps
