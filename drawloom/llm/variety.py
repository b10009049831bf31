"""A varied subset: distributed farthest-first k-center.

Every task reads its rows in chunks of at most CHUNK and picks representatives
by farthest-first traversal within each chunk: OVER times the share that is
asked for, and at least LEAST a chunk (or as many as asked for). The
representatives are pooled, and farthest-first traversal runs again over the
whole pool, in rounds: each round gathers the at most GATHER rows that lie
farthest from all picked so far, picks among them one by one as long as no row
left in the pool can lie noticeably farther, sends the picks to all tasks, and
every pooled row notes its distance to the nearest. So rows of all tasks are
compared with all picks, however large the pool.

A traversal's first rows are the subset of a smaller request: one traversal
serves all of them.

Distances are between unit vectors after a random projection to DIMENSIONS,
which keeps them within about a tenth, with the label as further coordinates:
drawings of different labels are at least 0.42 apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawloom.functions.arrays import class_id
from drawloom.llm.collisions import hash_share
from drawloom.llm.drawings import WIDTH, compact, unit, unpack
from drawloom.llm.storage import stored
from drawloom.sources.tables import latest_wide

CHUNK = 4096
OVER = 2.0
LEAST = 256
#: Pooled rows that reach the driver in a round, at most (about; 300 bytes each).
GATHER = 4096
#: A pick is at least this share of the distance that any row of the pool has.
NEARLY = 0.9
#: Distances are counted in steps of this.
STEP = 1 / 2048
DIMENSIONS = 64
CLASSES = 10
#: Weight of a different label against the distance of drawings (which is at most the root of 2).
LABEL_WEIGHT = 0.3
MAX_REQUESTS = 10_000
#: The distance of rows before anything is picked, further than any.
NOWHERE = 4.0


def projection(seed: int = 29) -> np.ndarray:
    return (np.random.default_rng(seed).standard_normal((WIDTH, DIMENSIONS)) / np.sqrt(DIMENSIONS)).astype(np.float32)


def farthest_first(z: np.ndarray, k: int, near: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, radii): up to k rows, each the farthest from those before it, and how far it was (inf for the first).

    near are distances to rows picked before, if there are any; it ends at the
    first row nearer than `least`, but not before one is picked. Ties go to the
    earlier row. Rows equal to picked ones come last, with radius 0.
    """
    n = len(z)
    k = min(k, n)
    if not k:
        return np.zeros(0, int), np.zeros(0)
    norms = np.einsum("ij,ij->i", z, z)
    picks, radii = np.empty(k, int), np.empty(k)
    squares = np.full(n, np.inf, np.float32) if near is None else (near.astype(np.float32) ** 2)
    at = int(np.argmax(squares))
    for i in range(k):
        radius = float(np.sqrt(max(squares[at], 0.0)))
        if i and radius < least:
            return picks[:i], radii[:i]
        picks[i], radii[i] = at, radius
        np.minimum(squares, norms + norms[at] - 2 * (z @ z[at]), out=squares)
        squares[at] = -1.0
        at = int(np.argmax(squares))
    return picks, radii


def with_label(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """z with a coordinate a label; a missing label (-1) is a zero there."""
    hot = np.zeros((len(z), CLASSES), np.float32)
    has = np.flatnonzero((label >= 0) & (label < CLASSES))
    hot[has, label[has]] = LABEL_WEIGHT
    return np.hstack([z, hot])


def representatives(rows: DataFrame, share: float, least: int) -> DataFrame:
    """(row_id, label, z): of every chunk that share of its rows, or `least` of them if that is more, by farthest-first."""

    def run(batches):
        plane = projection()
        ids, zs, labels = [], [], []

        def emit():
            i, z, label = np.concatenate(ids), np.concatenate(zs), np.concatenate(labels)
            ids.clear(), zs.clear(), labels.clear()
            i, first = np.unique(i, return_index=True)
            z, label = z[first], label[first]
            picks, _ = farthest_first(with_label(z, label), max(least, int(np.ceil(share * len(i)))))
            return pa.RecordBatch.from_arrays([pa.array(i[picks]), pa.array(label[picks].astype(np.int32)), pa.array([v.tobytes() for v in z[picks]], pa.binary())], names=["row_id", "label", "z"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids.append(part.column(0).to_numpy())
                zs.append(unit(unpack(part.column(1))) @ plane)
                labels.append(part.column(2).to_numpy())
                if sum(map(len, ids)) >= CHUNK:
                    yield emit()
        if ids and sum(map(len, ids)):
            yield emit()

    return rows.select("row_id", "v", "label").mapInArrow(run, "row_id bigint, label int, z binary")


STATE = "row_id bigint, label int, z binary, near double, place bigint, radius double"


def gathered(state: DataFrame) -> tuple[pa.Table, float]:
    """About the GATHER unpicked rows that lie farthest, ordered by row_id, and a distance that no other unpicked row exceeds.

    Where more rows than that share the largest distance (to STEP), some of them by hash.
    """
    open_ = state.where("place is null").withColumn("bin", F.floor(F.col("near") / STEP).cast("int"))
    counts = sorted(((r.bin, r["count"]) for r in open_.groupBy("bin").count().collect()), reverse=True)  # at most NOWHERE / STEP rows
    total, last = 0, None
    for bin_, n in counts:
        if total + n > GATHER:
            break
        total, last = total + n, bin_
    if last is not None:
        got, bound = open_.where(F.col("bin") >= last), last * STEP if len(counts) and last != counts[-1][0] else 0.0
    elif counts:
        top, n = counts[0]
        got, bound = open_.where((F.col("bin") == top) & hash_share("row_id", GATHER / n, 31)), (top + 1) * STEP
        if got.isEmpty():
            got = open_.where(F.col("bin") == top).limit(1)
    else:
        got, bound = open_, 0.0
    return got.select("row_id", "label", "z", "near").toArrow().sort_by("row_id"), bound


def traversal(pool: DataFrame, k: int) -> DataFrame:
    """STATE of the pool (row_id, label, z) with the place of up to k picked rows; it ends early where only rows equal to picked ones are left."""
    spark = pool.sparkSession
    state = stored(pool.select("row_id", "label", "z", F.lit(NOWHERE).alias("near"), F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("double").alias("radius")), "pool")
    placed = 0
    while placed < k:
        rows, bound = gathered(state)
        near = rows.column("near").to_numpy()
        if not len(near) or near.max() < STEP:
            break
        z = with_label(np.frombuffer(b"".join(rows.column("z").to_pylist()), np.float32).reshape(len(near), -1), rows.column("label").to_numpy())
        picks, radii = farthest_first(z, k - placed, near, max(NEARLY * bound, STEP))
        ids = rows.column("row_id").to_numpy()[picks]
        order = np.argsort(ids)
        shared = spark.sparkContext.broadcast((ids[order], (placed + order).astype(np.int64), radii[order], z[picks]))
        placed += len(picks)

        def note(batches, shared=shared):
            ids, places, radii, centres = shared.value
            squares = np.einsum("ij,ij->i", centres, centres)
            for batch in batches:
                mine = batch.column(0).to_numpy()
                at = np.searchsorted(ids, mine).clip(max=len(ids) - 1)
                now = ids[at] == mine
                near = batch.column(3).to_numpy().copy()
                z = with_label(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(batch.num_rows, -1), batch.column(1).to_numpy())
                own = np.einsum("ij,ij->i", z, z)
                for lo in range(0, len(centres), 1024):
                    best = (squares[lo : lo + 1024] - 2 * (z @ centres[lo : lo + 1024].T)).min(axis=1)
                    near = np.minimum(near, np.sqrt((best + own).clip(0)))
                place, radius = (batch.column(c).to_numpy(zero_copy_only=False).astype(float).copy() for c in (4, 5))
                place[now], radius[now] = places[at[now]], radii[at[now]]
                gone = np.isnan(place)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near), pa.array(np.where(gone, 0, place).astype(np.int64), mask=gone), pa.array(radius, mask=gone)], names=["row_id", "label", "z", "near", "place", "radius"])

        state = stored(state.mapInArrow(note, STATE), "pool")
    return state


def rest_by_hash(rows: DataFrame, k: int, first: int) -> DataFrame:
    """(row_id, label, place, radius 0.0): k of the rows by hash, placed from `first` on; no task puts more than a bucket in order."""
    dealt = rows.select("row_id", "label", F.xxhash64("row_id").alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 48).cast("int"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket").orderBy("h", "row_id")
    placed = dealt.join(before, "bucket").withColumn("at", F.row_number().over(order) + F.col("before")).where(F.col("at") <= k)
    return placed.select("row_id", "label", (F.col("at") - 1 + first).alias("place"), F.lit(0.0).alias("radius"))


def varied_subsets(examples: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, row_id, label, radius): for each request subset_rows row_ids of usable train drawings, or all if there are fewer.

    radius is how far the drawing was from those picked before it, null for the
    first. A null or non-positive subset_rows picks nothing; drawings without a
    label take part. Repeated deliveries count once, with the latest label.
    """
    spark = examples.sparkSession
    if requests.count() > MAX_REQUESTS:
        raise ValueError("too many requests")
    wanted = {r.request_id: int(r.subset_rows) for r in requests.collect() if r.subset_rows and r.subset_rows > 0}
    empty = spark.createDataFrame([], "request_id string, row_id bigint, label int, radius double")
    if not wanted:
        return empty
    held = latest_wide(examples.select("row_id", "loaded_at", "split", "x", "y")).withColumn("label", F.coalesce(class_id(F.col("y"), CLASSES), F.lit(-1)))
    train = stored(compact(held, "label").where("is_train").drop("is_train"), "train")
    n, k = train.count(), max(wanted.values())
    if not n:
        return empty
    pool = stored(representatives(train, min(1.0, OVER * k / n), min(k, LEAST)), "representatives")
    have = pool.count()  # at least k, or all
    state = traversal(pool, min(k, have))
    done = state.where("place is not null").select("row_id", "label", "place", "radius")
    placed = done.count()
    if placed < min(k, n):  # what is left equals picked rows
        picked = done.select("row_id")
        done = done.unionByName(rest_by_hash(train.select("row_id", "label").join(picked, "row_id", "left_anti"), k - placed, placed))
    each = F.explode(F.array(*[F.when(F.col("place") < size, F.lit(request)) for request, size in sorted(wanted.items())])).alias("request_id")
    out = done.select(each, "row_id", "label", "radius", "place").where("request_id is not null")
    radius = F.when(F.col("place") > 0, F.round("radius", 6))
    return out.select("request_id", "row_id", F.when(F.col("label") >= 0, F.col("label")).alias("label"), radius.alias("radius"))
