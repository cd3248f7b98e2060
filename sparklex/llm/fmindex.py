"""FM-index over a shard's word numbers: backward search by wavelet-matrix ranks, positions from sampled suffixes."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Each 0 is a separator that differs from every other one."""
    n = len(text)
    gap = text == 0
    gaps = int(gap.sum())
    rank = text.astype(np.int64) + gaps
    rank[gap] = np.arange(gaps)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + gaps + int(text.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: numbers below symbols, where 0 separates."""
        suffixes = suffix_array(text)
        n = len(text)
        before = text[suffixes - 1].copy()
        before[suffixes == 0] = 0
        self.n, self.last = n, before
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels = []  # of the wavelet matrix, high bits first: shift, ones before each place, number of zeros
        part = before
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (part >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((shift, ones, n - int(ones[-1])))
            part = np.concatenate((part[bit == 0], part[bit == 1]))
        self.sampled = (suffixes % SAMPLE == 0) | (before == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transformed text."""
        begin = np.zeros_like(place)
        for shift, ones, zeros in self.levels:
            bit = ((symbol >> shift) & 1).astype(bool)
            a, b = ones[begin], ones[place]
            begin = np.where(bit, zeros + a, begin - a)
            place = np.where(bit, zeros + b, place - b)
        return place - begin

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows, right-aligned: the last symbol in the last column)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            todo = live[length[live] >= back]
            c = phrases[todo, -back]
            lo[todo] = self.smaller[c] + self.rank(c, lo[todo])
            hi[todo] = self.smaller[c] + self.rank(c, hi[todo])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin: each steps back to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            r = rows[todo]
            c = self.last[r]
            rows[todo] = self.smaller[c] + self.rank(c, r)
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.samples[self.sample_at[rows]] + steps
