"""Votes of hashes on the bits of a SimHash."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, by byte of UTF-8.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Hashes whose bits are unpacked at a time.
_CHUNK = 1 << 15


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th hash made from a 64-bit one; the 0th is that itself."""
    if not n:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * n) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def votes(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each of 64 * width bits, how many hashes have it."""
    total = np.zeros(64 * width, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK]
        for n in range(width):
            bits = np.unpackbits(_mixed(part, n).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * n : 64 * n + 64] += bits.sum(axis=0, dtype=np.int32)
    return total


def simhash(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` 64-bit words; a bit is 1 if over half the hashes have it."""
    return np.packbits(2 * votes(hashes, width) > len(hashes), bitorder="little").view("<u8")
