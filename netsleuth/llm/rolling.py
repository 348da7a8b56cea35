"""Hashes of all windows of a byte string, in numpy."""

from __future__ import annotations

import numpy as np

from netsleuth.llm.util import worker_cache

#: Odd multiplier of the polynomial hash modulo 2**64, and the finaliser's factors.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse modulo 2**64."""
    cache = worker_cache()
    got = cache.get("powers")
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            have = 1
            while have < size:
                p[have:2 * have] = p[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            out.append(p)
        got = cache["powers"] = tuple(out)
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (in place)."""
    for shift, factor in zip((30, 27), MIX):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Prefix sums of one byte string, for hashes of any of its windows."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of ``width`` bytes (none if it does not fit)."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each [start, stop); equal bytes have equal hashes."""
        x = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(x ^ ((stop - start).astype(np.uint64) * np.uint64(MIX[1])))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    blocks = -(-len(x) // width)
    pad = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:len(x)] = x
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
