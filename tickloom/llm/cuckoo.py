"""A cuckoo filter over 64-bit hashes, held in one array: a helper for one shard's keys."""

from __future__ import annotations

import random

import numpy as np

SLOTS, MOST_KICKS = 4, 500


class Cuckoo:
    """Buckets of four 16-bit marks; a hash may lie in either of two buckets. No false negatives."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Room for ``n`` hashes at up to 80 % load."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    @property
    def count(self) -> int:
        return int(np.count_nonzero(self.table))

    @property
    def room(self) -> int:
        return int(self.table.size * 0.8) - self.count

    def _places(self, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.int64).view(np.uint64)
        marks = (h >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        low = np.int64(len(self.table) - 1)
        first = (h & np.uint64(low)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def _other(self, bucket, mark):
        """The second bucket of a mark; applied twice it gives the first."""
        return bucket ^ (np.asarray(mark).astype(np.int64) * 0x5BD1E995 & (len(self.table) - 1))

    def contains(self, hashes) -> np.ndarray:
        marks, a, b = self._places(hashes)
        return ((self.table[a] == marks[:, None]) | (self.table[b] == marks[:, None])).any(axis=1)

    def add(self, hashes) -> np.ndarray:
        """Insert; returns those that found no room."""
        hashes = np.asarray(hashes, np.int64)
        marks, *choices = self._places(hashes)
        todo = np.arange(len(hashes))
        for buckets in choices:
            order = todo[np.argsort(buckets[todo], kind="stable")]
            at = buckets[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table == 0
            fits = rank < free.sum(axis=1)[at]
            slots = np.argsort(~free, axis=1, kind="stable")
            self.table[at[fits], slots[at[fits], rank[fits]]] = marks[order[fits]]
            todo = order[~fits]
        return hashes[[i for i in todo if not self._kick(int(choices[1][i]), int(marks[i]))]]

    def _kick(self, bucket: int, mark: int) -> bool:
        """Make room by moving marks on; on failure every move is undone."""
        draw, moves = random.Random(mark * len(self.table) + bucket), []
        for _ in range(MOST_KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
            slot = draw.randrange(SLOTS)
            moves.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, moves[-1][2]
            bucket = int(self._other(bucket, mark))
        for at, slot, was in reversed(moves):
            self.table[at, slot] = was
        return False

    def discard(self, hashes) -> np.ndarray:
        """Remove one mark per hash; returns the hashes that have none here."""
        missing = []
        for h, mark, *buckets in zip(hashes, *self._places(hashes), strict=True):
            for b in buckets:
                hit = np.flatnonzero(self.table[b] == mark)
                if len(hit):
                    self.table[b, hit[0]] = 0
                    break
            else:
                missing.append(h)
        return np.asarray(missing, np.int64)
