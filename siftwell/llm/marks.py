"""Bitmaps of fixed size that spare rows the way to a costly step: no marked row is missed, some others pass too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the bits of a map.
BITMAP_BITS = 23
_U = np.uint64


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The map in which every long of hashes(h) is marked. It is put together by Spark; one map comes to the driver."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftrightunsigned(slot, 6).alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), "<u8")
    out[found["w"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be marked."""
    slot = (hashes >> _U(64 - BITMAP_BITS)).astype(np.int64)
    return bits[slot >> 6] >> (slot & 63).astype(_U) & _U(1) == 1
