"""Merge rules as a hash table in numpy arrays, and merging of single very long sequences."""

from __future__ import annotations

import heapq

import numpy as np

#: Longer sequences are merged one at a time with a heap instead of in a matrix or ragged array.
LONG = 512
NONE = np.int64(1 << 40)


class PairTable:
    """(left, right) -> (rank, merged id) by open addressing; lookups take whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, NONE), np.full(size, -1, np.int64)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            # Of several keys for one free slot the last writer keeps it; the others move on.
            self.keys[at[todo[free]]] = keys[todo[free]]
            placed = self.keys[at[todo]] == keys[todo]
            done = todo[placed]
            self.rank[at[done]], self.merged[at[done]] = rank[done], merged[done]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no rule) and merged id of each pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        got = self.keys[at]
        todo = np.flatnonzero((got != keys) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[at[todo]]
            todo = todo[(got != keys[todo]) & (got != -1)]
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], -1)


def merge_long(symbols: np.ndarray, table: PairTable) -> list[int]:
    """One sequence, its leftmost pair of lowest rank first, until no rule applies."""
    value, n = symbols.tolist(), len(symbols)
    rank, merged = (x.tolist() for x in table.find(symbols[:-1], symbols[1:]))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, value[i], value[i + 1], m) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, m = heapq.heappop(heap)
        j = after[i] if value[i] == left else n
        if j >= n or value[j] != right:
            continue  # one of the two has been merged meanwhile
        value[i], value[j] = m, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        near = [x for x in ((before[i], i), (i, after[i])) if x[0] >= 0 and x[1] < n]
        if near:
            lefts, rights = (np.array([value[x[k]] for x in near], np.int64) for k in (0, 1))
            ranks, ids = table.find(lefts, rights)
            for (a, _), x, y, r, merged_id in zip(near, lefts.tolist(), rights.tolist(), ranks.tolist(), ids.tolist(), strict=True):
                if r < NONE:
                    heapq.heappush(heap, (r, a, x, y, merged_id))
    return [v for v in value if v >= 0]
