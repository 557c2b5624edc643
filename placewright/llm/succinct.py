"""A sequence as a wavelet tree of bit vectors, with rank queries for many positions at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector of n bits and n/2 bits of counts; ``rank`` is the number of ones before each position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Symbols from 0 to ``sigma - 1``, split by one bit a level, the highest first; zeros of a level go before its ones."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        now = sequence
        for shift in range(self.depth - 1, -1, -1):
            bit = (now >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(now) - bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        symbols = np.arange(sigma)
        self.first = self._descend(symbols, np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, at) - self.first[symbol]

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol that occurs in each interval: (interval's number, symbol, rank at its start, rank at its end)."""
        which, symbol = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            a, b = bits.rank(low), bits.rank(high)
            left, right = np.flatnonzero(high - low > b - a), np.flatnonzero(b > a)
            which = np.concatenate([which[left], which[right]])
            symbol = np.concatenate([symbol[left], symbol[right] | (1 << shift)])
            low, high = np.concatenate([(low - a)[left], zeros + a[right]]), np.concatenate([(high - b)[left], zeros + b[right]])
        return which, symbol, low - self.first[symbol], high - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first ``depth`` symbols, by doubling prefixes."""
    n = len(text)
    rank, known = text.astype(np.int64), 1
    width = max(1, int(text.max(initial=0) + 1).bit_length())
    # The first sort takes as many symbols as one integer holds.
    while (known * 2) * width <= 62 and known < depth:
        rank = (rank << (width * known)) | np.concatenate([rank[known:], np.zeros(min(known, n), dtype=np.int64)])[:n]
        known *= 2
    order = np.argsort(rank)
    # From here on a suffix's rank is where its group of equal prefixes starts; only groups of several are sorted again.
    own = rank[order]
    starts = np.concatenate([[True], own[1:] != own[:-1]])[:n]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) if n else own
    open_ = np.flatnonzero(~(starts & np.append(starts[1:], True)[:n]))
    while known < depth and len(open_):
        some = order[open_]
        further = some + known
        key = rank[some] * (n + 1) + np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[open_] = some
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(starts, open_, 0))
        open_ = open_[~(starts & np.append(starts[1:], True))]
        known *= 2
    return order


class FMIndex:
    """Burrows-Wheeler transform of a text (symbols from 1 on; 0 ends a part and matches nothing) in a wavelet tree."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        sigma = int(text.max(initial=0)) + 1
        self.last = text[self.order - 1]  # the symbol before the first one is the last
        self.tree = WaveletTree(self.last, sigma)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        base = self.start[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def step(self) -> np.ndarray:
        """Where each rank goes when its suffix is extended by the symbol before it."""
        to = np.empty(len(self.last), dtype=np.int64)
        to[np.argsort(self.last.astype(np.uint16) if len(self.start) <= 1 << 16 else self.last, kind="stable")] = np.arange(len(self.last))
        return to
