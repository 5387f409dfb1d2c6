"""Bitmaps of a fixed size that tell whether a 64-bit hash may be in a set.

They are built by Spark, word by word, and are bounded by their size whatever
the set: a fuller bitmap lets more through and never less, so what it is used
for must be exact without it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """``2**bits`` bits as unsigned 64-bit words; bit ``h >> (64 - bits)`` is set for every hash.

    At most ``2**(bits - 6)`` rows reach the driver.
    """
    place = F.shiftrightunsigned(F.col(column).cast("bigint"), 64 - bits)
    words = (
        hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def maybe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap lets through."""
    bits = len(words).bit_length() - 1 + 6
    place = hashes >> np.uint64(64 - bits)
    return ((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
