"""A cuckoo filter over 64-bit hashes: 16-bit prints, four slots a bucket, insertion, deletion, lookup."""

from __future__ import annotations

import struct

import numpy as np

SLOTS, KICKS = 4, 500


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


class CuckooFilter:
    """No false negatives; a lookup is wrong for about 8 / 65535 of the keys that are not in it."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.slots = np.zeros((self.buckets, SLOTS), dtype=np.uint16) if slots is None else slots
        if slots is not None:
            self.buckets = len(slots)
        self._turn = 0

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mixed(keys)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, first ^ self._shift(prints)

    def _shift(self, prints: np.ndarray) -> np.ndarray:
        return (_mixed(prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(np.asarray(keys).astype(np.uint64))
        return ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if there was no room for all; the filter must then be built anew with more."""
        for p, *at in zip(*(a.tolist() for a in self._places(np.asarray(keys).astype(np.uint64))), strict=True):
            for b in at:
                free = np.flatnonzero(self.slots[b] == 0)
                if len(free):
                    self.slots[b, free[0]] = p
                    break
            else:
                b = at[0]
                for _ in range(KICKS):
                    self._turn = (self._turn + 1) % SLOTS
                    p, self.slots[b, self._turn] = int(self.slots[b, self._turn]), p
                    b ^= int(self._shift(np.array([p], dtype=np.uint16))[0])
                    free = np.flatnonzero(self.slots[b] == 0)
                    if len(free):
                        self.slots[b, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes one print of each key out; only keys that were inserted may be deleted."""
        for p, *at in zip(*(a.tolist() for a in self._places(np.asarray(keys).astype(np.uint64))), strict=True):
            for b in at:
                there = np.flatnonzero(self.slots[b] == p)
                if len(there):
                    self.slots[b, there[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return struct.pack("<I", self.buckets) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        (n,) = struct.unpack_from("<I", data)
        return cls(0, np.frombuffer(data, dtype=np.uint16, offset=4).reshape(n, SLOTS).copy())

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of keys, of which it holds one print each: more of one key would never find room."""
        keys = np.unique(keys)
        room = len(keys)
        while True:
            made = cls(room)
            if made.insert(keys):
                return made
            room = 2 * room + 8
