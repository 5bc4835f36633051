"""Vectors between Arrow lists, bytes and matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_rows(column: pa.Array) -> list[np.ndarray | None]:
    """One float64 array a row; null components become NaN, null rows None."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[i] : offsets[i + 1]] if valid[i] else None for i in range(len(column))]


def matrix(rows: list[bytes], dtype) -> np.ndarray:
    """Rows of bytes as a matrix, padded with zeros to the longest."""
    sizes = [len(r) for r in rows]
    width = max(sizes, default=0)
    if min(sizes, default=0) < width:
        rows = [r.ljust(width, b"\0") for r in rows]
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)
