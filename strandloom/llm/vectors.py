"""What the operators on vectors share: which rows count, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond these are clamped: floor(scale * x) of a double need not fit a long.
CLAMP = 1 << 62


def whole(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def floored(vector: Column, scale: int = 64) -> Column:
    """Each entry x, as double, as the long floor(scale * x)."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(CLAMP)), F.lit(-CLAMP)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of int64; shorter rows end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def widest(x: np.ndarray) -> int:
    """Greatest magnitude in an integer array."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact(x: np.ndarray, terms: int, most: int) -> np.ndarray:
    """x as int64 where a sum of `terms` products of numbers up to `most` fits, else as Python integers."""
    return x.astype(np.int64, copy=False) if terms * most * most < 1 << 62 else x.astype(object)

