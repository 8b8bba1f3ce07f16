"""A compressed FM-index over words: wavelet matrix of bit vectors with rank directories, vectorised backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of each place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        first = np.arange(symbols, dtype=np.int64) * 0
        all_symbols = np.arange(symbols, dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            b = (seq >> level) & 1
            v = BitVector(b.astype(np.uint8))
            zeros = len(seq) - int(b.sum())
            self.bits.append(v)
            self.zeros.append(zeros)
            one = (all_symbols >> level) & 1 == 1
            r = v.rank(first)
            first = np.where(one, zeros + r, first - r)
            one = b == 1
            seq = np.concatenate([seq[~one], seq[one]])
        self.first = first  # where each symbol starts below the last level

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is found in front of place i."""
        at = i
        for k, (v, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            r = v.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, zeros + r, at - r)
        return at - self.first[symbol]


def prefix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` symbols at least, by doubling from as many symbols as a key holds."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    k = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] += text[j:] + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = new
        if k >= depth or rank.max() == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (int(second.max()) + 1) + second
        k *= 2


class FmIndex:
    """Of a text of symbols from 1 on; 0 separates its parts. Finds patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.order = prefix_order(text, depth)
        self.wavelet = WaveletMatrix(text[self.order - 1], symbols)  # the symbol in front of each suffix
        counts = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        self.counts = counts

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns text[s : s + length]: the numbers of those that the index holds twice or more, and their
        intervals. The matching statistic of the others ends where one place or none is left."""
        live = np.arange(len(starts))
        last = text[starts + length - 1]
        low = self.first[last]
        high = low + self.counts[last]
        for k in range(length - 2, -1, -1):
            go = high - low > 1
            live, low, high = live[go], low[go], high[go]
            if not len(live):
                break
            low, high = self.extend(text[starts[live] + k], low, high)
        go = high - low > 1
        return live[go], low[go], high[go]
