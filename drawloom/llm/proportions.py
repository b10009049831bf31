"""A sample whose categories have target shares, by swap repair of signature counts.

Records are grouped by category signature (here the label). From a random
sample that meets the floors, units are exchanged between signatures as long as
that lowers the deviation from the targets; only counts take part in this. The
sample is then made by taking that many records of each signature by random
hash: a histogram of the hashes finds the bucket where each count ends, and only
that bucket's records are put in order, so that no signature is sorted whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawloom.functions.arrays import class_id
from drawloom.llm.storage import stored
from drawloom.sources.tables import latest, split_name

BUCKETS = 4096
#: Rows of the target table that reach the driver; more raise an error.
MAX_TARGETS = 100_000


def swap_repair(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts a signature: at most what is available, at least the floors that can be had, as near to share * size as exchanges bring them.

    The deviation is the sum of squared differences. The sample is smaller than
    `size` only if fewer records are there; floors that together exceed `size` are kept.
    """
    available = available.astype(np.int64)
    low = np.minimum(floor, available).astype(np.int64)
    size = int(min(size, available.sum()))
    counts = low.copy()
    missing = size - int(counts.sum())
    if missing > 0:
        counts += rng.multivariate_hypergeometric(available - counts, missing, method="marginals")
    wanted = share * size
    while len(counts) > 1:
        # over is where giving one up helps most, under where one more helps most
        gain_drop = np.where(counts > low, 2 * (counts - wanted) - 1, -np.inf)
        gain_add = np.where(counts < available, 2 * (wanted - counts) - 1, -np.inf)
        over, under = int(np.argmax(gain_drop)), int(np.argmax(gain_add))
        if over == under or gain_drop[over] + gain_add[under] <= 1e-9:
            break
        # as many as still help at once: half the distance between the two differences
        room = (counts[over] - wanted[over]) - (counts[under] - wanted[under])
        step = int(max(1, min(room // 2, counts[over] - low[over], available[under] - counts[under])))
        counts[over] -= step
        counts[under] += step
    return counts


def labelled_train(examples: DataFrame, classes: int = 10) -> DataFrame:
    """(row_id, label) of the train row_ids; the label of the latest delivery, null where there is none."""
    rows = latest(examples.select("row_id", "loaded_at", "split", "y"))
    return rows.where(split_name() == "train").select("row_id", class_id(F.col("y"), classes).alias("label"))


def plan_counts(labels: DataFrame, targets: DataFrame, seed: int) -> list[tuple]:
    """For each row of targets: available, sampled, and what is needed. Nulls in targets count as 0.

    Labels that a plan does not name are not sampled for it.
    """
    if targets.count() > MAX_TARGETS:
        raise ValueError("too many targets")
    have = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("available"))
    rows = targets.where("plan_id is not null").join(have, "label", "left").orderBy("plan_id", "label").collect()
    out = []
    for plan_id in sorted({r.plan_id for r in rows}):
        mine = [r for r in rows if r.plan_id == plan_id]
        available = np.array([r.available or 0 for r in mine], np.int64)
        share = np.array([r.target_share or 0.0 for r in mine])
        floor = np.array([r.min_rows or 0 for r in mine], np.int64)
        size = max([r.sample_rows or 0 for r in mine])
        rng = np.random.default_rng([seed, *plan_id.encode()])
        counts = swap_repair(available, share, floor, size, rng)
        for r, a, c, s, f in zip(mine, available, counts, share, floor):
            needed = max(float(f), round(float(s) * size, 6))
            out.append((plan_id, r.label, int(size), float(s), int(f), float(needed), int(a), int(c), bool(a >= needed)))
    return out


REPORT = "plan_id string, label int, sample_rows bigint, target_share double, min_rows bigint, needed double, available bigint, sampled bigint, met boolean"


def proportional_sample(examples: DataFrame, targets: DataFrame, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """(sample, report): (plan_id, row_id, label) and one row for each row of targets, met saying whether its target can be had.

    Rows of null row_id, other splits or without a label are never sampled; no targets give no sample.
    """
    spark = examples.sparkSession
    labels = labelled_train(examples).where("label is not null")
    labels = stored(labels, "labels")
    rows = plan_counts(labels, targets, seed)
    report = spark.createDataFrame(rows, REPORT)
    takes = F.broadcast(report.where("sampled > 0").select("plan_id", "label", "sampled"))
    drawn = labels.join(takes, "label").withColumn("h", F.xxhash64("plan_id", "row_id", F.lit(seed)))
    dealt = drawn.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 1), 63 - 12).cast("int"))
    counts = dealt.groupBy("plan_id", "label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("plan_id", "label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")  # at most BUCKETS rows a plan and label
    placed = dealt.join(before, ["plan_id", "label", "bucket"]).where(F.col("before") < F.col("sampled"))
    order = Window.partitionBy("plan_id", "label", "bucket").orderBy("h", "row_id")
    sample = placed.withColumn("at", F.row_number().over(order)).where(F.col("before") + F.col("at") <= F.col("sampled"))
    return sample.select("plan_id", "row_id", "label"), report


def unmet(sample: DataFrame, report: DataFrame) -> DataFrame:
    """(plan_id, label) of the targets that the rows drawn fall short of, and that all rows with the label would not meet."""
    drawn = sample.groupBy("plan_id", "label").agg(F.count(F.lit(1)).alias("drawn"))
    short = report.join(drawn, ["plan_id", "label"], "left").where(F.coalesce("drawn", F.lit(0)) < F.col("needed"))
    return short.where("not met").select("plan_id", "label")
