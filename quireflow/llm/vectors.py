"""Stored vectors as exact integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def largest_step(width: int, factor: int) -> int:
    """Largest power of two ``b`` for which ``factor * width * b * b`` stays within 62 bits."""
    b = 1
    while factor * max(width, 1) * (2 * b) ** 2 <= 2**62:
        b *= 2
    return b


def integers(vector: pa.Array, width: int, scale: int, bound: int) -> np.ndarray:
    """``floor(scale * x)`` of each component, within ``bound``; shorter vectors are padded with zeros."""
    if isinstance(vector, pa.ChunkedArray):
        vector = vector.combine_chunks()
    sizes = np.asarray(vector.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(vector.flatten(), dtype=np.float64)
    whole = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = whole
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as hold them."""
    most = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``; by floating point where that is exact."""
    top = (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)
