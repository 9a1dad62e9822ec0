"""Ids of pieces of text, remembered by hash in arrays: some twenty bytes a piece, so a worker keeps half a million."""

from __future__ import annotations

import numpy as np

SLOTS, PROBES, LONGEST = 1 << 20, 8, 1 << 12
U = np.uint64


class Table:
    """An open-addressed table from (64-bit hash, 32-bit check) to a run of ids.

    All look-ups and insertions are array operations. When half the slots are taken, pieces that were not
    looked up since the last time are dropped.
    """

    def __init__(self, dtype: np.dtype, slots: int = SLOTS):
        self.dtype, self.slots = dtype, slots
        self._empty()

    def _empty(self) -> None:
        n = self.slots
        self.key, self.check = np.zeros(n, U), np.zeros(n, np.uint32)
        self.begin, self.size, self.used = np.zeros(n, np.int32), np.zeros(n, np.uint16), np.zeros(n, bool)
        self.pool, self.filled, self.count = np.zeros(1 << 16, self.dtype), 0, 0

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key + U(probe)) & U(self.slots - 1)).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not remembered."""
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for probe in range(PROBES):
            if not len(left):
                break
            at = self._slot(key[left], probe)
            there = self.key[at]
            hit = (there == key[left]) & (self.check[at] == check[left])
            out[left[hit]] = at[hit]
            left = left[~hit & (there != 0)]
        self.used[out[out >= 0]] = True
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember distinct new keys with their ids, which stand one after the other; very long runs are not kept."""
        if self.count + len(key) > self.slots // 2:
            self._forget()
        if self.count + len(key) > self.slots // 2 or len(ids) > 1 << 30:
            return
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.filled], np.zeros(self.filled + 2 * len(ids), self.dtype)))
        self.pool[self.filled : self.filled + len(ids)] = ids
        begins = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)
        left = np.flatnonzero((sizes < LONGEST) & (key != 0))
        for probe in range(PROBES):
            at = self._slot(key[left], probe)
            _, first = np.unique(at, return_index=True)
            first = first[self.key[at[first]] == 0]
            here, now = at[first], left[first]
            self.key[here], self.check[here], self.begin[here], self.size[here] = key[now], check[now], begins[now], sizes[now]
            self.used[here] = True
            self.count += len(now)
            left = np.delete(left, first)
            if not len(left):
                break

    def _forget(self) -> None:
        kept = np.flatnonzero(self.used & (self.key != 0))
        if len(kept) > self.slots // 4:
            kept = kept[: self.slots // 4]
        key, check, size = self.key[kept], self.check[kept], self.size[kept].astype(np.int64)
        ids = take(self.pool, self.begin[kept].astype(np.int64), size)
        self._empty()
        self.add(key, check, ids, size)
        self.used[:] = False


def take(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin and have sizes as given, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
