"""A compressed full-text index over word numbers: Burrows-Wheeler transform, wavelet matrix, backward search.

Everything is in numpy and works on many searches at once. Bit vectors are packed into 64-bit words with one running
count a word, so a level of the matrix takes 1.5 bits a symbol.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in order, by prefix doubling; the end counts as less than any symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])]) if n else []
        rank = fresh
        if n == 0 or int(rank.max()) == n or k >= n:
            return order
        k *= 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Symbols by place, most significant bit first; counts a symbol before a place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, (sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            below, above = self.bits[i].ones(low), self.bits[i].ones(at)
            low = np.where(one, self.zeros[i] + below, low - below)
            at = np.where(one, self.zeros[i] + above, at - above)
        return at - low


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, weights: np.ndarray | None = None):
        """text: symbols 0 .. sigma - 1; weights: how often what stands at each place occurs (once, if not given)."""
        order = suffix_order(text)
        self.heavy = np.concatenate([[0, 0], np.cumsum(weights[order] if weights is not None else np.ones(len(text), np.int64))])
        # The empty suffix is first; the symbol before the whole text is a stop that no search asks for.
        last = np.concatenate([text[-1:], np.where(order > 0, text[order - 1], sigma)]) if len(text) else np.array([], np.int64)
        self.rows = len(last)
        self.tree = WaveletMatrix(last, sigma + 1)
        self.first = 1 + np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place in `ends`, the length (up to its `most`) of the longest run ending there that occurs `least` times or more."""
        length = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.rows, np.int64)
        for step in range(int(most.max(initial=0))):
            inside = most[alive] > step
            alive, low, high = alive[inside], low[inside], high[inside]
            if not len(alive):
                break
            at = ends[alive] - step
            symbol = text[at]
            low = self.first[symbol] + self.tree.count(symbol, low)
            high = self.first[symbol] + self.tree.count(symbol, high)
            found = self.heavy[high] - self.heavy[low] >= least
            alive, low, high = alive[found], low[found], high[found]
            length[alive] = step + 1
        return length
