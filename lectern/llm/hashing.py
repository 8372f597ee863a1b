"""Vectorised 64-bit hashes of byte substrings from one table of prefix sums."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []

#: A random odd number for each byte.
BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 17)
        _tables[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(p))])) for p in (_P, pow(_P, -1, 1 << 64))]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Sums:
    """Hashes of substrings of one byte string."""

    def __init__(self, a: np.ndarray):
        n = len(a)
        up, self.down = power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[a] * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hashes of [start, end); equal strings of one length have equal ones."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]
