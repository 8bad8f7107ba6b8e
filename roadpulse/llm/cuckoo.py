"""A cuckoo filter over 16-byte keys: 16-bit fingerprints, four to a bucket, two buckets per key."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


class Full(Exception):
    """No room for a key; a larger filter is needed."""


class CuckooFilter:
    """Set membership with deletion: never says no to a key it holds, seldom yes to another."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for so many keys at four fifths full; the number of buckets is a power of two."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as rows of two unsigned 64-bit integers."""
        mark = ((keys[:, 0] >> np.uint64(48)) | np.uint64(0)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        # Not by the lowest 16 bits: keys of one shard agree in some of these.
        first = (keys[:, 1] >> np.uint64(16)) & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint, the same both ways."""
        step = mark.astype(np.uint64) * np.uint64(0x5BD1E995)
        return (bucket ^ step) & self.mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        here = (self.table[first.astype(np.int64)] == mark[:, None]).any(1)
        return here | (self.table[second.astype(np.int64)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Add keys, each counted once more; raises Full without room."""
        spot = np.random.default_rng(7)
        for mark, first, second in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (first, second):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = second
                for _ in range(KICKS):
                    slot = int(spot.integers(SLOTS))
                    mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                    bucket = int(self._other(np.array([bucket], np.uint64), np.array([mark], np.uint16))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    raise Full

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added before, each once."""
        for mark, first, second in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (first, second):
                there = np.flatnonzero(self.table[bucket] == mark)
                if len(there):
                    self.table[bucket, there[0]] = 0
                    break
