"""FM-index over a wavelet matrix, with queries in lock-step."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least (prefix doubling)."""
    n, h = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[0, np.cumsum(k[1:] != k[:-1])]
        rank[order] = new
        h *= 2
        if new[-1] == n - 1 or h >= depth:
            return order


class Bits:
    """Bit vector in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """text: symbols from 1, with 0 between and after passages.  Patterns shorter than `depth` and without 0 are counted exactly."""

    def __init__(self, text: np.ndarray, depth: int):
        text = text.astype(np.int64)
        order = suffix_order(text, depth)
        column = text[order - 1]
        self.n, top = len(text), int(text.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top))][:-1]
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bit = (column >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), len(bit) - int(bit.sum())))
            column = np.r_[column[bit == 0], column[bit == 1]]
        self.begin = np.zeros(top, np.int64)
        head = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        self.begin[column[head]] = head

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the last column."""
        i = i.copy()
        for shift, bits, zeros in self.levels:
            one = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + one, i - one)
        return i - self.begin[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A backward step: the intervals of symbol + pattern."""
        both = self.rank(np.r_[symbol, symbol], np.r_[lo, hi]) + np.r_[self.first[symbol], self.first[symbol]]
        return both[: len(lo)], both[len(lo) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """Matching statistics: for each end, the longest stretch of text that stops there and occurs twice or more, up to `longest`.

        All ends step backward together; those whose interval falls below two suffixes stop."""
        out = np.zeros(len(ends), np.int64)
        live, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for step in range(longest):
            lo, hi = self.extend(text[ends[live] - step].astype(np.int64), lo, hi)
            on = hi - lo >= 2
            live, lo, hi = live[on], lo[on], hi[on]
            if not len(live):
                break
            out[live] = step + 1
        return out
