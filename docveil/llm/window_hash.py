"""Hashes of text windows from prefix sums modulo 2**64, without a loop over characters."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Two odd bases, one for each hash; any odd number has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 1 << 23:  # tables for one giant text are not kept
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class WindowHash:
    """Hash of any window of a code point array in constant time."""

    def __init__(self, cp: np.ndarray, which: int = 0):
        self.up, self.down = _tables(BASES[which], len(cp) + 1)
        self.sums = np.zeros(len(cp) + 1, U)
        spread = (cp.astype(U) + U(which + 1)) * U(0x9E3779B97F4A7C15)
        spread ^= spread >> U(32)
        spread *= U(0xD6E8FEB86659FD93)
        spread ^= spread >> U(32)
        spread *= self.up[: len(cp)]
        np.cumsum(spread, out=self.sums[1:])

    def at(self, start: np.ndarray, width) -> np.ndarray:
        return mixed((self.sums[start + width] - self.sums[start]) * self.down[start])
