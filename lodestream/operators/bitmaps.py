"""Bitmaps of fixed size over hashed keys: they may be broadcast, admit every key and few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 2**26, eight megabytes, whatever the number of keys. Beyond some tens of millions of keys it admits
#: more and more others; what follows it checks the keys themselves.
BITS = 26


def bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """The bitmap of the keys (longs): the low bits of each, mixed, are its place. At most 2**20 words reach the driver."""
    place = F.pmod(F.xxhash64(key.cast("long")), F.lit(1 << BITS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")
    )
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[np.asarray(found["w"])] = np.asarray(found["b"]).view(np.uint64)
    return out


def xxhash64_of_longs(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for each long (XXH64 of its eight bytes)."""
    p1, p2, p3, p4, p5 = (
        np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.full(keys.shape, seed + 8, np.uint64) + p5
        h ^= turn(keys.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def admits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (longs) the bitmap admits."""
    place = xxhash64_of_longs(np.ascontiguousarray(keys)) & np.uint64((1 << BITS) - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
