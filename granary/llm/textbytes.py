"""Byte-level helpers shared by the operators that look at raw UTF-8: window hashes and content-chosen anchors."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A fixed random 64-bit value for each byte.
BYTE_CODE = np.random.default_rng(20240611).integers(1, 2**63 - 1, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WindowHasher:
    """Hashes every window of a fixed byte length at once; equal bytes give equal hashes wherever they stand.

    The sums are polynomials modulo 2**64 that are shifted back to exponent 0 and then mixed, so that all bits count.
    """

    def __init__(self) -> None:
        self._up = powers(BASE, 1 << 16)
        self._down = powers(BASE_INVERSE, 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self._up):
            size = 1 << int(n - 1).bit_length()
            self._up, self._down = powers(BASE, size), powers(BASE_INVERSE, size)

    def windows(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        total = self.sums(data)
        return mix((total[length:] - total[:n]) * self._down[:n])

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums, of which `of` makes the hashes of any windows."""
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * self._up[: len(data)], out=total[1:])
        return total

    def scale(self, n: int) -> np.ndarray:
        """What shifts differences of running sums that begin at places 0 .. n - 1 to exponent 0."""
        self._grow(n + 1)
        return self._down[:n]

    def of(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """The hashes of the windows of one length that begin at the given places."""
        return mix((sums[starts + length] - sums[starts]) * self._down[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_PLACE = np.uint64((1 << 28) - 1)


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every run of `width` neighbours, leftmost on ties, ascending.

    Two equal runs choose the same place in each, so equal passages share an anchor wherever they stand.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    out = []
    step = 1 << 22
    for at in range(0, n - width + 1, step):
        part = hashes[at : at + step + width - 1]
        low = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        chosen = (low & _PLACE).astype(np.int64)
        out.append(chosen[np.r_[True, chosen[1:] != chosen[:-1]]] + at)
    chosen = np.concatenate(out)
    return chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
