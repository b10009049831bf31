"""Fixed-size, padded, shuffled mini-batches as rows.

The order is by `shuffle_key`, a portable permutation key of (row_id, epoch);
row numbers are global without ever sorting all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multipliers and modulus of the portable shuffle key (fixed values).
KEY_ROW, KEY_EPOCH, KEY_PRIME = 7919, 104729, 1000003


def shuffle_key(row_id: Column, epoch: int | Column = 0) -> Column:
    """A key in 0..KEY_PRIME-1; equal keys are told apart by row_id."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.pmod(row_id.cast("bigint") * KEY_ROW + epoch.cast("bigint") * KEY_EPOCH, F.lit(KEY_PRIME))


def ranked(df: DataFrame, key: Column, tie: str, upper: int, name: str = "rn", buckets: int = 1024, within: tuple[str, ...] = ()) -> DataFrame:
    """df with its 1-based position in the order of (key, tie), among rows of equal `within`; key lies in 0..upper-1.

    Rows are cut into key ranges; each range is numbered by its own task and
    shifted by the rows before it (at most `buckets` counts for each value of
    `within`, which is what is broadcast). Rows with a null tie are dropped.
    """
    k, b, shift = "__drawloom_key", "__drawloom_bucket", "__drawloom_shift"
    keyed = df.where(F.col(tie).isNotNull()).withColumn(k, key).withColumn(b, F.floor(F.col(k) * buckets / upper).cast("int"))
    counts = keyed.groupBy(*within, b).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*within).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, b, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    inside = Window.partitionBy(*within, b).orderBy(k, tie)
    return keyed.join(F.broadcast(offsets), [*within, b]).withColumn(name, F.row_number().over(inside) + F.col(shift)).drop(k, b, shift)


def make_batches(rows: DataFrame, batch_size: int = 32, epoch: int = 0, reshuffle: bool = True) -> DataFrame:
    """(epoch, batch_id, pos, row_id, is_pad): every row once, the last batch filled from the head of the order.

    Repeated row_ids count once, null ones not at all; no rows give no batches.
    With reshuffle=False every epoch has the order of epoch 0. A table smaller
    than its pads repeats the order as often as needed.
    """
    return _batches(rows, [epoch], batch_size, reshuffle)


def _batches(rows: DataFrame, epochs: list[int], batch_size: int, reshuffle: bool) -> DataFrame:
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    ids = rows.select(F.col("row_id").cast("bigint").alias("row_id")).where(F.col("row_id").isNotNull()).distinct()
    each = ids.select(F.explode(F.array(*[F.lit(e) for e in epochs])).alias("epoch"), "row_id")
    key = shuffle_key(F.col("row_id"), F.col("epoch") if reshuffle else 0)
    order = ranked(each, key, "row_id", KEY_PRIME, within=("epoch",))
    n = ids.agg(F.count("row_id").alias("n"))
    pads = F.pmod(-F.col("n"), F.lit(batch_size))
    real = order.select("epoch", "row_id", (F.col("rn") - 1).alias("at"), F.lit(False).alias("is_pad"))
    turns = F.explode(F.sequence(F.lit(0), F.floor((pads - F.col("rn")) / F.col("n")).cast("int"))).alias("turn")
    heads = order.where(F.col("rn") < batch_size).join(F.broadcast(n)).where(F.col("rn") <= pads)
    filled = heads.select("epoch", "row_id", "rn", "n", turns).select(
        "epoch", "row_id", (F.col("n") + F.col("rn") - 1 + F.col("turn") * F.col("n")).alias("at"), F.lit(True).alias("is_pad")
    )
    return real.unionByName(filled).select(
        "epoch",
        F.floor(F.col("at") / batch_size).cast("int").alias("batch_id"),
        (F.col("at") % batch_size).cast("int").alias("pos"),
        "row_id",
        "is_pad",
    )


def epochs_of(rows: DataFrame, epochs: int, batch_size: int = 32, reshuffle: bool = True) -> DataFrame:
    """make_batches of epochs 0..epochs-1 below each other, put in order beside each other; only ids are moved."""
    return _batches(rows, list(range(epochs)), batch_size, reshuffle)


def limit_batches(batches: DataFrame, limit: int) -> DataFrame:
    """The first `limit` batches of each epoch; 0 means all."""
    return batches if limit == 0 else batches.where(F.col("batch_id") < limit)


def distinct_places(batches: DataFrame) -> DataFrame:
    """One row a place: repeated deliveries of (epoch, batch_id, pos) count once, a null is_pad is no pad."""
    return batches.groupBy("epoch", "batch_id", "pos").agg(
        F.min("row_id").alias("row_id"), F.coalesce(F.min("is_pad"), F.lit(False)).alias("is_pad")
    )


def head_rows(batches: DataFrame, n: int, batch_size: int = 32) -> DataFrame:
    """The first n rows in batch order: a filter on the place, no sort."""
    at = F.col("batch_id").cast("bigint") * batch_size + F.col("pos")
    return batches.where(at < n)


def stack(*frames: DataFrame) -> DataFrame:
    """Row-wise concatenation; duplicates stay."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def descriptors(examples: DataFrame, batch_size: int = 32) -> DataFrame:
    """Name, shape and element type of what the batch iterator hands out, for each array column."""
    kinds = dict(examples.dtypes)
    widths = examples.agg(F.max(F.size("x")).alias("x"), F.max(F.size("y")).alias("y"))
    return widths.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.lit(batch_size).alias("rows"), F.col(c).alias("width"), F.lit(kinds[c]).alias("dtype"))
                    for name, c in (("data", "x"), ("label", "y"))
                ]
            )
        ).alias("d")
    ).select("d.*")
