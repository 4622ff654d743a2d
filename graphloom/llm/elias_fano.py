"""Elias-Fano sequences in numpy: monotone integers in little memory.

The low bits of each value stand in an array, in whole bytes; the rest is a bit vector in which
the i-th one lies at ``(value >> bits) + i``. Counts of ones per 512 bits make
both kinds of select a search in a small array.
"""

from __future__ import annotations

import math
import os

import numpy as np

_NAMES = ("meta", "low", "words", "ones")


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Position of the k-th (from 0) one, or zero, bit."""
    block = np.searchsorted(before, k, side="right") - 1
    rest = k - before[block]
    word = block * 8
    for _ in range(7):
        bits = words[word] if not zeros else ~words[word]
        have = np.bitwise_count(bits).astype(np.int64)
        go = rest >= have
        rest = np.where(go, rest - have, rest)
        word = word + go
        if not go.any():
            break
    bits = words[word] if not zeros else ~words[word]
    place = np.zeros(len(k), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        part = bits & np.uint64((1 << step) - 1)
        have = np.bitwise_count(part).astype(np.int64)
        go = rest >= have
        rest = np.where(go, rest - have, rest)
        bits = np.where(go, bits >> np.uint64(step), part)
        place += go * step
    return word * 64 + place


class EliasFano:
    def __init__(self, meta, low, words, ones):
        self.n, self.size, self.bits = (int(x) for x in meta)
        self.low, self.words = np.asarray(low), np.asarray(words)  # views of the mapped files
        self.ones = np.asarray(ones)
        self.zeros = np.arange(len(self.ones)) * 512 - self.ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        """From non-decreasing values, all below ``universe``."""
        values = np.ascontiguousarray(values, "<u8")
        n = len(values)
        bits = min(56, max(0, int(math.log2(max(universe, 1)) - math.log2(max(n, 1)))))
        size = (bits + 7) // 8
        low = (values & np.uint64((1 << bits) - 1)).view(np.uint8).reshape(n, 8)[:, :size].copy()
        length = n + (int(universe) >> bits) + 2
        flags = np.zeros((length + 511) // 512 * 512, bool)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        words = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.r_[0, np.cumsum(np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.int64))]
        return cls((n, size, bits), low, words, ones)

    def save(self, path: str) -> None:
        for name, array in zip(_NAMES, (np.array([self.n, self.size, self.bits]), self.low, self.words, self.ones)):
            np.save(f"{path}.{name}.npy", array)

    @classmethod
    def load(cls, path: str) -> "EliasFano":
        """Memory-mapped."""
        return cls(*[np.load(f"{path}.{name}.npy", mmap_mode="r" if os.path.getsize(f"{path}.{name}.npy") > 4096 else None)
                     for name in _NAMES])

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, :self.size] = self.low[at]
        return out.view("<u8")[:, 0]

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        high = _select(self.words, self.ones, at, False) - at
        return high.astype(np.uint64) << np.uint64(self.bits) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is missing: the values of one high
        part stand between two zeros, and their successor is found by halving."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        want = values & np.uint64((1 << self.bits) - 1)
        low = np.zeros(len(values), np.int64)
        inner = high > 0
        if inner.any():
            low[inner] = _select(self.words, self.zeros, high[inner] - 1, True) + 1 - high[inner]
        end = _select(self.words, self.zeros, high, True) - high
        top = end.copy()
        live = np.flatnonzero(low < top)
        while len(live):
            mid = (low[live] + top[live]) >> 1
            less = self._low(mid) < want[live]
            low[live] = np.where(less, mid + 1, low[live])
            top[live] = np.where(less, top[live], mid)
            live = live[low[live] < top[live]]
        out = np.full(len(values), -1, np.int64)
        hit = np.flatnonzero(low < end)
        hit = hit[self._low(low[hit]) == want[hit]]
        out[hit] = low[hit]
        return out
