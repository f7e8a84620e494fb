"""FM-index over word sequences: Burrows-Wheeler transform in a wavelet matrix, searched backwards in step for
many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with 64-bit words and a count before each word, for rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Symbols by bit planes, the highest bit first; zeros of a plane stand before its ones in the next."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            self.planes.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(at)
        for plane, zeros, level in zip(self.planes, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = plane.ones(start), plane.ones(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start


def sorted_suffixes(text: np.ndarray, context: int) -> np.ndarray:
    """Start of each suffix in the order of its first `context` symbols, by doubling."""
    rank = text.astype(np.int64)
    span, order = 1, np.argsort(rank, kind="stable")
    while span < context:
        after = np.zeros(len(rank), np.int64)
        after[:len(rank) - span] = rank[span:] + 1
        key = rank * (len(rank) + text.max() + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        span *= 2
    return order


class FMIndex:
    """Index of a text of symbols from 0 to size - 1 that begins and ends with the mark 0, for patterns without marks of
    up to `context` symbols."""

    def __init__(self, text: np.ndarray, size: int, context: int) -> None:
        self.places = sorted_suffixes(text, context)
        self.bwt = WaveletMatrix(text[self.places - 1].astype(np.int64), size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def intervals(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of the `length` symbols of `text` before each end, by backward search.

        Matching statistics grow by one symbol a step; a pattern whose range has shrunk to one place is only found
        there and is dropped (its range stays empty).
        """
        low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        a, b = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.places), np.int64)
        for step in range(1, length + 1):
            symbol = text[ends[live] - step].astype(np.int64)
            a = self.first[symbol] + self.bwt.rank(symbol, a)
            b = self.first[symbol] + self.bwt.rank(symbol, b)
            more = b - a > 1
            live, a, b = live[more], a[more], b[more]
        low[live], high[live] = a, b
        return low, high
