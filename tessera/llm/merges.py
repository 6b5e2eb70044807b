"""Byte-pair merges over many short words at once, as arrays.

Words of one length are rows of a matrix of ids. In each round every row merges its pair of the lowest rank, leftmost among
equals, and loses one column, so the matrix stays dense; rows without a pair leave it. Pairs are looked up in an open
hash table of arrays.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(1 << 30)


class PairTable:
    """(left id, right id) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key, first = np.unique(key, return_index=True)  # the first of a repeated pair holds
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, who = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][who]
            self.keys[slots], self.rank[slots], self.merged[slots] = key[placed], first[placed], merged[first[placed]]
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at = self._slot(key)
        have = self.keys[at]
        miss = np.flatnonzero((have != key) & (have != -1))
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            have = self.keys[at[miss]]
            miss = miss[(have != key[miss]) & (have != -1)]
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE).reshape(left.shape), np.where(hit, self.merged[at], 0).reshape(left.shape)


def merge_rows(ids: np.ndarray, table: PairTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts (rows, their final ids as a matrix) that cover all rows of ``ids``."""
    rows, out = np.arange(len(ids)), []
    rank, merged = table.find(ids[:, :-1], ids[:, 1:])
    while ids.shape[1] > 1:
        at = rank.argmin(axis=1)
        done = rank[np.arange(len(rank)), at] == _NONE
        if done.any():
            out.append((rows[done], ids[done]))
            go = ~done
            rows, ids, rank, merged, at = rows[go], ids[go], rank[go], merged[go], at[go]
            if not len(rows):
                return out
        n, width = ids.shape
        every = np.arange(n)
        ids[every, at] = merged[every, at]
        keep = np.ones((n, width), bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(n, width - 1)
        if width == 2:
            break
        # The pair goes; those on its left and right are looked up anew.
        keep = np.ones((n, width - 1), bool)
        keep[every, at] = False
        rank, merged = rank[keep].reshape(n, width - 2), merged[keep].reshape(n, width - 2)
        for shift in (-1, 0):
            some = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
            p = at[some] + shift
            rank[some, p], merged[some, p] = table.find(ids[some, p], ids[some, p + 1])
    if len(rows):
        out.append((rows, ids))
    return out
