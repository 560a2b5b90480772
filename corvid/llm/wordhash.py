"""Vectorised word splitting and 64-bit word hashes over UTF-8 buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII characters
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z).  Every byte of
a non-ASCII character is at least 0x80, so the class can be tested per byte.
"""
from __future__ import annotations

import numpy as np

_B = np.arange(256)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)
#: by lower-cased byte
IS_WORD = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrapping multiplies and shifts)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        def powers(base):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)
        _POW, _INV = powers(_MULT), powers(pow(_MULT, -1, 1 << 64))
    return _POW[:n], _INV[:n]


def words(offsets: np.ndarray, raw: np.ndarray):
    """Words of consecutive texts: (lower-cased bytes, starts, ends, words per text)."""
    low = LOWER[raw]
    inside = IS_WORD[low]
    n = len(low)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edge = offsets[1:-1]
        before[edge[edge < n]] = False
        after[edge[(edge > 0)] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return low, starts, ends, counts


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial in its bytes, by prefix sums."""
    power, inverse = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODE[low] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
