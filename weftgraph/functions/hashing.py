"""64-bit hashes that agree between Spark expressions and numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public xxHash64 algorithm; Spark's xxhash64 starts from seed 42.
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5, _SEED = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5), np.uint64(42)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """``xxhash64`` of bigint columns, as Spark computes it."""
    with np.errstate(over="ignore"):
        seed = np.full(len(columns[0]), _SEED)
        for column in columns:
            x = column.astype(np.int64).view(np.uint64)
            h = seed + _P5 + np.uint64(8)
            h = h ^ (_turn(x * _P2, 31) * _P1)
            h = _turn(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            seed = h ^ (h >> np.uint64(32))
    return seed.view(np.int64)


def key_pair(*columns: Column) -> tuple[Column, Column]:
    """A 128-bit key of the columns as two bigints; null differs from every value."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(*marked), F.xxhash64(F.lit(7), *marked)
