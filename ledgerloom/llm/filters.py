"""A filter of keys that every task holds, sized by how many keys there are."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of the smallest and of the largest filter (16 MB), as powers of two
LEAST, MOST = 20, 27
#: bits of one bitmap of ``bitmap_construct_agg``
_CHUNK = 1 << 15


def slot(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(1 << bits))


def build(keys: DataFrame, hashed: Column) -> tuple[int, np.ndarray]:
    """(bits, packed bitmap) of the slots of all keys: eight bits a key, within the bounds.

    The bitmap is put together by the tasks in chunks, of which at most
    2^MOST / 2^15 reach the driver. With more keys than it has room for it lets
    more through, and never loses one.
    """
    n = keys.count()
    bits = min(MOST, max(LEAST, math.ceil(math.log2(8 * n + 1))))
    at = slot(hashed, bits) + 1  # positions count from 1
    chunks = keys.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map")).collect()
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for c in chunks:
        a = (c.chunk - 1) * (_CHUNK // 8)
        packed[a : a + _CHUNK // 8] = np.frombuffer(bytes(c.map), np.uint8)
    return bits, packed


def held(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
