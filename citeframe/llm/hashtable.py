"""A read-only open-addressing hash table over numpy arrays, looked up many keys at a time."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class HashTable:
    """Maps uint64 keys (all ones is reserved) to int32 values; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        values = np.asarray(values, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, _FREE, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        slot = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == _FREE]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``, a flat uint64 array."""
        slot = self._home(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found != _FREE))
        while len(left):
            at = (slot[left] + 1) & self.mask
            slot[left] = at
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (found != _FREE)]
        return out
