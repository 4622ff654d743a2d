"""Rank-synchronous byte-pair merges over ragged numpy arrays.

A batch of pre-tokens is one flat array of symbol ids with sequence numbers.
Every round finds the lowest-rank pair of each sequence and applies it to all
its places in that sequence at once, for all sequences together, until no
sequence has a pair left.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class Merges:
    """Pair ranks. ``pairs`` holds (left, right, merged) in order of rank."""

    def __init__(self, pairs: np.ndarray, byte_ids: np.ndarray):
        key = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = pairs[:, 2].astype(np.int64)
        self.byte_ids = byte_ids.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where there is no such merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in a row and the number of symbols of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_seq = [], []
        while len(sym):
            rank = np.full(len(sym), NONE)  # of the pair that begins here
            inner = seq[:-1] == seq[1:]
            rank[:-1][inner] = self.rank(sym[:-1][inner], sym[1:][inner])
            start = np.flatnonzero(np.r_[True, ~inner])
            lowest = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            best = np.repeat(lowest, length)
            hit = (rank == best) & (best != NONE)
            # a pair of equal symbols may overlap itself: of a run of hits, take every other one from the left
            place = np.arange(len(sym))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            live = best != NONE
            done_sym.append(sym[~live])
            done_seq.append(seq[~live])
            keep &= live
            sym, seq = sym[keep], seq[keep]
        seq = np.concatenate([*done_seq, np.empty(0, np.int64)])
        order = np.argsort(seq, kind="stable")
        out = np.concatenate([*done_sym, np.empty(0, np.int64)])[order]
        return out, np.bincount(seq, minlength=len(words))
