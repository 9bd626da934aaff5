"""A compressed FM-index over a sequence of integers: bit-packed wavelet matrix and backward search.

All searches run over arrays of queries at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their next `depth` symbols, equal ones by position; and where in that order the first depth - 1 symbols change.

    Symbols beyond the end count as none. Ranks by k symbols give ranks by up to 2k.
    """
    n, rank, k = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")

    def ahead(by: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        out[: max(0, n - by)] = rank[by:]
        return out

    while k < depth:
        short = depth - 1
        if k <= short <= 2 * k:
            first = rank, ahead(short - k)
        by = min(k, depth - k)
        key = rank * (int(rank.max(initial=0)) + 2) + ahead(by) + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))[:n]
        k += by
    new = np.ones(n, bool)
    if depth > 1:
        a, b = first[0][order], first[1][order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    elif n:
        new[1:] = False
    return order, new


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = len(bits) - int(np.bitwise_count(self.words).sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a text of symbols 1..; 0 separates parts, and no pattern contains it.

    Suffixes are ordered by `depth` symbols, which is enough for patterns of up to that length. first_of and end_of
    give, for each suffix, the interval of those that share its first depth - 1 symbols (the parent's interval).
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        order, new = suffix_order(text, depth)
        self.positions = order.astype(np.int32)
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        self.first_of, self.end_of = heads[of], np.append(heads[1:], len(text))[of]
        bwt = text[self.positions - 1]
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:-1]
        self.levels: list[Bits] = []
        self.height = max(1, (symbols - 1).bit_length())
        starts = np.zeros(symbols, np.int64)
        all_symbols = np.arange(symbols)
        for level in reversed(range(self.height)):
            bit = (bwt >> level) & 1
            bits = Bits(bit)
            self.levels.append(bits)
            starts = self._down(bits, starts, (all_symbols >> level) & 1)
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.starts = starts

    @staticmethod
    def _down(bits: Bits, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = bits.ones(at)
        return np.where(bit == 1, bits.zeros + ones, at - ones)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each bound `at` of the interval of a pattern, that of symbol + pattern."""
        low = at
        for level, bits in zip(reversed(range(self.height)), self.levels, strict=True):
            low = self._down(bits, low, (symbol >> level) & 1)
        return self.first[symbol] + low - self.starts[symbol]

    def stream(self, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts of the text, streamed against the index, match `depth` symbols: the intervals (low, high) of counts[i] windows from starts[i] on.

        Parts run from right to left side by side. The last window takes `depth` backward steps. Each window before it takes one: the
        match drops its last symbol, which widens its interval to the parent's, and a backward step adds the symbol on its left.
        A window occurs where it was read, at least, so no match ever breaks off.
        """
        ends = np.cumsum(counts)
        low, high = np.zeros(ends[-1] if len(ends) else 0, np.int64), np.zeros(ends[-1] if len(ends) else 0, np.int64)
        last = starts + counts - 1
        a, b = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text), np.int64)
        for back in reversed(range(self.depth)):
            symbol = self.text[last + back]
            a, b = self.step(symbol, a), self.step(symbol, b)
        at, left = np.arange(len(starts)), 0
        while len(at):
            low[ends[at] - 1 - left], high[ends[at] - 1 - left] = a, b
            left += 1
            go = counts[at] > left
            at, a = at[go], a[go]
            symbol = self.text[last[at] - left]
            a, b = self.step(symbol, self.first_of[a]), self.step(symbol, self.end_of[a])
        return low, high
