"""Readers and writers of the canonical tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from drawloom.session import cut, table_path

#: Keys that may be broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000

SCHEMAS = {
    "examples": "row_id bigint, split string, x array<float>, y array<float>",
    "batches": "epoch int, batch_id int, pos int, row_id bigint, is_pad boolean",
    "params": "run_id string, epoch int, layer int, unit int, activation string, w array<double>, b double",
    "predictions": "row_id bigint, y array<float>, output array<double>",
    "history": "run_id string, epoch int, avg_loss double, seconds double, num_batches int, "
    "train_acc double, train_top3 double, test_acc double, test_top3 double",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; a missing column raises, further columns pass through."""
    df = spark.read.parquet(table_path(sf_dir, name))
    wanted = T._parse_datatype_string(SCHEMAS[name]).fieldNames() if name in SCHEMAS else []
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    return df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def from_arrays(spark: SparkSession, x: np.ndarray, y: np.ndarray, split: str, first_id: int = 0) -> DataFrame:
    """Small host arrays (rows by columns) as examples rows; row position becomes row_id."""
    if len(x) != len(y):
        raise ValueError("x and y differ in rows")
    rows = [(first_id + i, split, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMAS["examples"])


def to_arrays(df: DataFrame, column: str, limit_bytes: int = 1 << 28) -> np.ndarray:
    """One array column on the driver, in row_id order.

    Refuses, before anything is moved, columns larger than limit_bytes.
    """
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    if n * max(width or 0, 0) * 8 > limit_bytes:
        raise ValueError(f"{n} rows of {width} values are too large for the driver")
    rows = df.orderBy("row_id").select(column).collect()
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(n, -1)


def latest(examples: DataFrame, key: str = "row_id", version: str = "loaded_at") -> DataFrame:
    """One row a key: the delivery with the latest version.

    Rows without a key are dropped; a null version is the oldest. Where two
    deliveries have the same version, the one whose whole row hashes lowest is
    kept, so that the result does not depend on file order.
    """
    order = [F.col(version).desc_nulls_last()] if version in examples.columns else []
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in examples.columns])
    w = Window.partitionBy(key).orderBy(*order, tie)
    rank = "__drawloom_rank"
    return examples.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def latest_wide(rows: DataFrame, key: str = "row_id", version: str = "loaded_at") -> DataFrame:
    """latest() for wide rows of which few are delivered again: only those are moved.

    The repeated keys are found on (key, version) alone. They are broadcast if
    they are at most BROADCAST_ROWS (16 bytes each); beyond that they are joined
    by shuffle.
    """
    top = "__drawloom_top"
    narrow = rows.where(F.col(key).isNotNull()).select(key, version)
    repeated = cut(narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(version).alias(top)).where("n > 1").drop("n"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    once = rows.where(F.col(key).isNotNull()).join(side.select(key), key, "left_anti")
    again = latest(rows.join(side, key).where(F.col(version).eqNullSafe(F.col(top))).select(*rows.columns), key, version)
    return once.unionByName(again)


def split_name(column: str = "split"):
    """Split names without stray blanks or case."""
    return F.lower(F.trim(F.col(column)))
