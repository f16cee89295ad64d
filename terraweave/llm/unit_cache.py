"""Ids of repeated units of text, kept in sorted arrays of bounded bytes.

Units are known by their 64-bit string hash within one process; two different units
share one with a chance of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

UNIT_BYTES = 20  # key, place and length of a kept unit


class _Table:
    def __init__(self, dtype: np.dtype) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, dtype)

    @property
    def nbytes(self) -> int:
        return UNIT_BYTES * len(self.keys) + self.ids.nbytes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it here, place) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Ascending keys that are not here yet, with the ids of all in their order."""
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.starts = np.insert(self.starts, where, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, where, sizes)
        self.ids = np.concatenate([self.ids, ids])


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that start at ``starts``, one behind the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes, dtype=np.int64) - sizes), sizes)
    return ids[shift + np.arange(total)]


class UnitCache:
    """Two generations of units: when one is full, it becomes the older and the older one goes."""

    def __init__(self, limit: int, dtype) -> None:
        self.limit, self.dtype = limit // 2, np.dtype(dtype)
        self.young, self.old = _Table(self.dtype), _Table(self.dtype)

    def encode(self, units: list[str], encode: Callable[[list[str]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each); ``encode`` gives the ids of units that are not kept."""
        keys, first, back = np.unique(np.fromiter(map(hash, units), np.int64, len(units)), return_index=True, return_inverse=True)
        here, at = self.young.find(keys)
        out = np.flatnonzero(~here)
        if len(out):
            known, place = self.old.find(keys[out])
            sizes = np.zeros(len(out), np.int32)
            sizes[known] = self.old.sizes[place[known]]
            found = encode([units[i] for i in first[out[~known]].tolist()])
            sizes[~known] = [len(x) for x in found]
            pool = np.concatenate([self.old.ids, *found]) if found else self.old.ids
            starts = np.zeros(len(out), np.int64)
            starts[known] = self.old.starts[place[known]]
            fresh = sizes[~known].astype(np.int64)
            starts[~known] = len(self.old.ids) + np.cumsum(fresh) - fresh
            self.young.add(keys[out], sizes, gather(pool, starts, sizes).astype(self.dtype))
            here, at = self.young.find(keys)
        sizes = self.young.sizes[at][back]
        ids = gather(self.young.ids, self.young.starts[at][back], sizes)
        if self.young.nbytes > self.limit:
            self.old, self.young = self.young, _Table(self.dtype)
        return ids, sizes
