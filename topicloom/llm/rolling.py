"""Hashes of byte strings from prefix sums, modulo 2^64, for whole arrays at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sums:
    """hash(starts, ends) of stretches of a buffer; equal bytes give equal hashes wherever they lie."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[buf] * up[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of the length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])
