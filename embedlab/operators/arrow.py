"""Arrow batch to NumPy matrix, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as ``(rows, width)`` float64; ragged or null rows are an error."""

    rows = len(column)
    if column.null_count:
        raise ValueError("a vector is missing on one side")
    offsets = np.asarray(column.offsets)
    widths = np.diff(offsets)
    if rows and (widths != widths[0]).any():
        raise ValueError(f"vector widths differ: {widths.min()} to {widths.max()}")
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    if values.null_count:
        raise ValueError("a vector holds a null")
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1)


def list_array(rows: np.ndarray) -> pa.Array:
    """``(rows, width)`` as a list column."""

    rows = np.ascontiguousarray(rows, dtype=np.float64)
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with column ``name`` added or replaced in place."""

    names = batch.schema.names
    columns = [values if n == name else batch.column(n) for n in names]
    if name not in names:
        names, columns = [*names, name], [*columns, values]
    return pa.RecordBatch.from_arrays(columns, names=names)
