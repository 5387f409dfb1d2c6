"""Parity sketches of shingle sets, and the keys under which similar sets meet.

A parity sketch has one bit per possible hash; each shingle flips its own.  Bits
that two sketches differ in are at most the shingles their sets differ in, and for a
Jaccard similarity of 3/4 or more that is at most a seventh of the sizes' sum.
The sketch is cut into more parts than that, by the leading bits of the hash, so
similar sets agree on all but that many parts.  Put in one common order, the first
``differences + 2`` parts of either set then contain two that both share.
"""

from __future__ import annotations

import numpy as np

from perilgrid.llm.bits import maybe
from perilgrid.llm.words import mix

_U = np.uint64
_PART = _U(0xC2B2AE3D27D4EB4F)
FOLDED_BITS = 512
#: Sets larger than ``WIDE_FROM`` also get a longer one, as the short one fills up.
WIDE_BITS, WIDE_FROM = 4096, 400


def most_differences(n: int) -> int:
    """Shingles in which a set of ``n`` and any set similar to it may differ."""
    return (n + 4 * n // 3) // 7


def size_bands(n: int) -> list[int]:
    """Band ``j`` has sizes from 4**j up to 4**(j+1).

    Two sets meet in the band of the larger one, so a set also goes into the next
    band if similar sets may be large enough for that.
    """
    own = (n.bit_length() - 1) // 2
    return [own, own + 1] if 4 * n // 3 >= 4 ** (own + 1) else [own]


def band_keys(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of a set of sorted distinct hashes; similar sets share at least two.

    A part's value is the XOR of its shingles' codes.  The common order puts
    parts with more shingles that are not ``hot`` (a bitmap of frequent ones)
    first, then goes by the key itself, and puts empty parts last.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    want = most_differences(n) + 2
    codes = mix(shingles)
    cold = ~maybe(hot, shingles)
    out = []
    for band in size_bands(n):
        bits = 2 * (band + 1)
        part = shingles >> _U(64 - bits)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        place = part[at] + _U(band << 40)
        key = mix(np.bitwise_xor.reduceat(codes, at) ^ (place * _PART))
        if len(key) > want:
            cold_in = np.minimum(np.add.reduceat(cold, at, dtype=np.int64), 3).astype(np.uint64)
            order = ((_U(3) - cold_in) << _U(62)) | (key >> _U(2))
            key = key[np.argpartition(order, want - 1)[:want]]
        elif len(key) < want:
            empty = np.setdiff1d(np.arange(1 << bits, dtype=np.uint64), part[at]) + _U(band << 40)
            blank = mix(empty * _PART)
            key = np.concatenate((key, np.sort(blank)[: want - len(key)]))
        out.append(key)
    return np.concatenate(out)


def folded(shingles: np.ndarray, bits: int = FOLDED_BITS) -> np.ndarray:
    """The sketch folded to ``bits`` bits (as 64-bit words), which can only bring two sketches closer."""
    place = (shingles & _U(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
