"""Cuckoo filters over 16-byte digests: approximate sets that forget what is removed."""

from __future__ import annotations

import numpy as np

from repoquarry.llm.words import mix

SLOTS = 4
# Share of the slots that a new filter is planned to use; above the second, one is full.
PLANNED = 0.7
FULL = 0.9
_KICKS = 500


class Cuckoo:
    """Buckets of ``SLOTS`` 16-bit fingerprints; a digest lies in one of two buckets.

    The other bucket follows from a bucket and the fingerprint alone, so fingerprints can be moved
    without their digests. What was inserted is always found; removing is allowed for what was inserted,
    once for each time.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def planned(cls, n: int) -> Cuckoo:
        """An empty filter for ``n`` digests."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, n) / (SLOTS * PLANNED)))))
        return cls(np.zeros((buckets, SLOTS), dtype="<u2"))

    @classmethod
    def of(cls, digests: list[bytes]) -> Cuckoo:
        """A filter that holds ``digests``, as large as that takes."""
        room = len(digests)
        while True:
            made = cls.planned(room)
            if made.insert(digests):
                return made
            room = 2 * max(1, room)

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of every digest. The first half of a digest picks its shard."""
        half = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, 1]
        prints = (half >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (half & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, first ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, digests: list[bytes]) -> np.ndarray:
        """Whether each digest may have been inserted; never false for one that was."""
        prints, first, other = self._places(digests)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(axis=1) | (self.table[other] == wanted).any(axis=1)

    def insert(self, digests: list[bytes]) -> bool:
        """Whether all found room; if not, the filter is of no further use and is to be made anew."""
        if len(self) + len(digests) > FULL * self.table.size and len(digests):
            return False
        prints, first, other = self._places(digests)
        left = np.arange(len(digests))
        for buckets in (first, other):
            left = left[~self._placed(prints[left], buckets[left])]
        return all(self._moved_in(prints[i], int(other[i])) for i in left)

    def _placed(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; which ones found one."""
        order = np.argsort(buckets, kind="stable")
        sorted_buckets = buckets[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_buckets, sorted_buckets)
        free = self.table[sorted_buckets] == 0
        chosen = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        found = chosen.any(axis=1)
        self.table[sorted_buckets[found], chosen[found].argmax(axis=1)] = prints[order[found]]
        out = np.zeros(len(order), dtype=bool)
        out[order] = found
        return out

    def _moved_in(self, value: np.uint16, bucket: int) -> bool:
        """Puts one fingerprint into a full bucket by moving others to their other buckets."""
        for kick in range(_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = value
                return True
            slot = (kick * 7 + bucket) % SLOTS
            row[slot], value = value, row[slot].copy()
            bucket ^= int(self._step(np.array([value]))[0])
        return False

    def remove(self, digests: list[bytes]) -> None:
        """Takes out one fingerprint for each digest."""
        for value, *buckets in zip(*self._places(digests), strict=True):
            for bucket in buckets:
                at = np.flatnonzero(self.table[bucket] == value)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
