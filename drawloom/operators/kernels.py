"""Arrow to NumPy and back, for the few kernels that leave the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, ok) of a list column: ok marks rows of exactly `width` values, none null or NaN.

    values holds the ok rows only, in order, as float64; nothing is copied row by row.
    """
    n = len(column)
    if n == 0:
        return np.zeros((0, width)), np.zeros(0, bool)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    flat = column.values
    sizes = np.diff(offsets)
    ok = (sizes == width) & ~np.asarray(column.is_null())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null becomes NaN
    if ok.all():
        picked = values[offsets[0] : offsets[0] + n * width].reshape(n, width)
    else:
        starts = offsets[:-1][ok]
        picked = values[(starts[:, None] + np.arange(width)[None, :]).reshape(-1)].reshape(-1, width)
    whole = ~np.isnan(picked).any(axis=1)
    if not whole.all():
        ok[np.flatnonzero(ok)[~whole]] = False
        picked = picked[whole]
    return picked, ok


def lists(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    """A list column: the rows of values where ok, null elsewhere."""
    width = values.shape[1]
    sizes = np.where(ok, width, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))
    if ok.all():
        return out
    return pa.ListArray.from_buffers(out.type, len(ok), [pa.array(ok).buffers()[1], out.buffers()[1]], children=[out.values])
