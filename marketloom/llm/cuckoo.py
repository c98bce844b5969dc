"""A cuckoo filter over 64-bit keys: membership without false negatives, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may rest in either of two buckets, so a fingerprint can be taken out again.

    Keys that find no place after MAX_KICKS moves go to an exact overflow list, so nothing is ever lost. Each key is to be
    inserted once; the exact table behind the filter sees to that.
    """

    def __init__(self, table: np.ndarray, overflow: set[int]):
        self.table, self.overflow = table, overflow

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), set())

    def _home(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = _mix(keys), np.uint64(len(self.table) - 1)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = h & mask
        return mark, one.astype(np.int64), (one ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (_mix(mark.astype(np.int64)) >> np.uint64(7)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._home(keys)
        found = ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)
        return found | np.isin(keys, np.fromiter(self.overflow, np.int64, len(self.overflow))) if self.overflow else found

    def insert(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(0)
        for key, mark, one, two in zip(np.asarray(keys).tolist(), *(x.tolist() for x in self._home(keys)), strict=True):
            if not (self._put(one, mark) or self._put(two, mark)) and not self._kick(two, mark, rng):
                self.overflow.add(key)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def _kick(self, bucket: int, mark: int, rng: np.random.Generator) -> bool:
        path = []
        for _ in range(MAX_KICKS):
            slot = int(rng.integers(SLOTS))
            path.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, int(self.table[bucket, slot])
            bucket ^= int(self._jump(np.array([mark], np.uint16))[0])
            if self._put(bucket, mark):
                return True
        for bucket, slot, old in reversed(path):  # as it was before: only the new key overflows
            self.table[bucket, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        for key, mark, one, two in zip(np.asarray(keys).tolist(), *(x.tolist() for x in self._home(keys)), strict=True):
            if key in self.overflow:
                self.overflow.discard(key)
                continue
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        rest = np.fromiter(self.overflow, np.int64, len(self.overflow))
        return np.array([len(self.table)], np.int64).tobytes() + self.table.tobytes() + rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        table = np.frombuffer(data, np.uint16, n * SLOTS, 8).reshape(n, SLOTS).copy()
        return cls(table, set(np.frombuffer(data, np.int64, -1, 8 + n * SLOTS * 2).tolist()))
