"""An FM-index over integer symbols: a wavelet matrix with bit-packed ranks, backward search for many queries at once."""

from __future__ import annotations

import numpy as np

_ONE, _SIX, _LOW = np.uint64(1), np.int64(6), np.int64(63)


class Bits:
    """A packed bit row with rank: the number of ones before each place in O(1), 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, bool)), bitorder="little").view("<u8")
        self.word = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> _SIX
        mask = (_ONE << (i & _LOW).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.word[w] & mask)


class WaveletMatrix:
    """Occurrences of any symbol before any place, in one bit-row lookup for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.rows: list[tuple[Bits, int]] = []
        row = symbols
        for b in range(self.levels - 1, -1, -1):
            bits = (row >> b & 1).astype(bool)
            self.rows.append((Bits(bits), int(len(row) - bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])
        # where each symbol's run begins in the last row
        ids, first = np.unique(row, return_index=True)
        self.first = np.zeros(n_symbols, np.int64)
        self.first[ids] = first

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i entries are ``symbol`` (both arrays)."""
        at = i
        for k, (bits, zeros) in enumerate(self.rows):
            one = bits.rank(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + one, at - one)
        return at - self.first[symbol]


def suffix_array(text: np.ndarray, most: int) -> np.ndarray:
    """Order of all suffixes by their first ``most`` symbols at least (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < most:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Counts of any pattern in a text of symbols ≥ 1, in which 0 separates pieces and never matches.

    ``weight``: how often each place of the text stands for an occurrence (once without it), so a piece that is met many times is indexed once.
    """

    def __init__(self, text: np.ndarray, longest: int, weight: np.ndarray | None = None):
        text = np.append(text, 0)
        self.n_symbols = int(text.max()) + 1
        order = suffix_array(text, longest)
        self.bwt = WaveletMatrix(text[order - 1], self.n_symbols)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        self.size = len(text)
        self.weight = np.arange(len(text) + 1) if weight is None else np.concatenate([[0], np.cumsum(np.append(weight, 1)[order])])  # of the first i suffixes

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``symbol`` and go on as those of [lo, hi)."""
        both = self.bwt.occurrences(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        at = self.start[symbol]
        return at + both[: len(symbol)], at + both[len(symbol) :]

    def statistics(self, query: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 1) -> np.ndarray:
        """Matching statistics: for each query range [begin, end), how far back from its last symbol a match
        goes that occurs ``least`` times in the text. All queries advance one symbol to the left together."""
        m = len(begin)
        length = np.zeros(m, np.int64)
        live = np.arange(m)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        at = end - 1
        while len(live):
            live = live[(at[live] >= begin[live])]
            lo_, hi_ = self.step(query[at[live]], lo[live], hi[live])
            ok = self.weight[hi_] - self.weight[lo_] >= least
            live = live[ok]
            lo[live], hi[live] = lo_[ok], hi_[ok]
            length[live] += 1
            at[live] -= 1
        return length
