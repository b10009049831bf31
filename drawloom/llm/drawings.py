"""Usable drawings as compact vectors.

A usable drawing has exactly WIDTH values, none null or NaN, not all equal.
Whole values 0..255 are kept as one byte each, other values as float32 exactly
as stored, so that cosines computed later are those of x as stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 784
SIDE = 28


def compact(examples: DataFrame, *others: str) -> DataFrame:
    """(row_id, is_train, v) of the usable drawings, and the columns named in `others`; no more are read.

    Later deliveries of a row_id repeat its x and split, so all of them come
    through here; readers drop repeats of a row_id where they meet. Rows with a
    null row_id are dropped; a null split is not train.
    """
    train = F.coalesce(F.lower(F.trim(F.col("split"))) == "train", F.lit(False))
    narrow = examples.where("row_id is not null and x is not null").select("row_id", train.alias("is_train"), "x", *others)

    def run(batches):
        for batch in batches:
            ok, packed = pack(batch.column(2))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), packed, *[c.filter(keep) for c in batch.columns[3:]]], names=["row_id", "is_train", "v", *others])

    schema = T.StructType.fromDDL("row_id bigint, is_train boolean, v binary")
    return narrow.mapInArrow(run, T.StructType([*schema, *[narrow.schema[c] for c in others]]))


def pack(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which rows are usable, and those rows' bytes."""
    offsets = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    ok = (np.diff(offsets) == WIDTH) & ~np.asarray(column.is_null())
    if not ok.any():
        return ok, pa.array([], pa.binary())
    if ok.all():
        x = flat[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
    else:
        x = flat[(offsets[:-1][ok][:, None] + np.arange(WIDTH)).reshape(-1)].reshape(-1, WIDTH)
    low, high = x.min(axis=1), x.max(axis=1)  # NaN where a value is NaN
    good = high > low
    if not good.all():
        ok[np.flatnonzero(ok)[~good]] = False
        x, low, high = x[good], low[good], high[good]
    if not len(x):
        return ok, pa.array([], pa.binary())
    with np.errstate(invalid="ignore"):
        small = np.clip(x, 0, 255).astype(np.uint8)
    whole = (low >= 0) & (high <= 255) & (small == x).all(axis=1)
    if whole.all():
        ends = np.arange(len(x) + 1, dtype=np.int32) * WIDTH
        return ok, pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(small)])
    return ok, pa.array([small[i].tobytes() if whole[i] else x[i].tobytes() for i in range(len(x))], pa.binary())


def unpack(column: pa.Array) -> np.ndarray:
    """Rows of values as stored, float32 (exact: bytes and float32 are both within it)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return np.zeros((0, WIDTH), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    if (sizes == WIDTH).all():
        return data[offsets[0] : offsets[-1]].reshape(n, WIDTH).astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    narrow = np.flatnonzero(sizes == WIDTH)
    out[narrow] = data[offsets[:-1][narrow][:, None] + np.arange(WIDTH)]
    for i in np.flatnonzero(sizes != WIDTH):
        out[i] = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), np.float32)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, float32."""
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows in double precision."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256].astype(np.float64)
        out[lo : lo + 256] = np.sqrt(np.einsum("ij,ij->i", part, part))
    return out


def exact_cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows a[i] and b[j] in double precision."""
    out = np.empty(len(i))
    na = lengths(a)
    nb = na if b is a else lengths(b)
    for lo in range(0, len(i), 256):
        p, q = i[lo : lo + 256], j[lo : lo + 256]
        out[lo : lo + 256] = np.einsum("ij,ij->i", a[p].astype(np.float64), b[q].astype(np.float64)) / (na[p] * nb[q])
    return out


def displaced(x: np.ndarray, down: int, right: int) -> np.ndarray:
    """Every drawing moved; pixels moved out are lost, zeros move in."""
    grid = x.reshape(-1, SIDE, SIDE)
    out = np.zeros_like(grid)
    h, w = SIDE - abs(down), SIDE - abs(right)
    r, c = max(down, 0), max(right, 0)
    out[:, r : r + h, c : c + w] = grid[:, max(-down, 0) : max(-down, 0) + h, max(-right, 0) : max(-right, 0) + w]
    return out.reshape(-1, WIDTH)


#: All displacements of at most one pixel along each axis.
DISPLACEMENTS = [(down, right) for down in (-1, 0, 1) for right in (-1, 0, 1)]
