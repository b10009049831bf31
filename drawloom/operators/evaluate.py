"""Evaluation procedures: metrics of a network, global accuracy, the right and the wrong rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.functions.arrays import fixed, title, to_grid
from drawloom.operators.batching import head_rows, shuffle_key
from drawloom.operators.metrics import composite, scored
from drawloom.operators.network import Weights, forward


def evaluate_accuracy(rows: DataFrame, weights: Weights) -> DataFrame:
    """acc and top3 of a network over all rows given, pads included where the caller joined them in."""
    return composite(scored(forward(rows, weights, keep=["y"])))


def accuracy_percent(predictions: DataFrame, n_rows: int | None = None, batch_size: int = 32) -> DataFrame:
    """Percent right among the first n_rows in batch order (needs batch_id, pos), or among all rows."""
    rows = predictions if n_rows is None else head_rows(predictions, n_rows, batch_size)
    s = scored(rows)
    return s.agg(
        F.count("label").alias("n_rows"),
        F.count_if("is_correct").alias("n_correct"),
        (F.lit(100.0) * F.count_if("is_correct") / F.nullif(F.count("label"), F.lit(0))).alias("pct"),
    )


def split_correct(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(right, wrong) rows; rows that cannot be scored are in neither."""
    s = scored(predictions)
    return s.where(F.col("is_correct")), s.where(~F.col("is_correct"))


def plot_examples(predictions: DataFrame, count: int = 8, height: int = 28, width: int = 28) -> DataFrame:
    """Titles (and grids, where x is there) of `count` rows, chosen by the portable shuffle key."""
    s = scored(predictions).where(F.col("label").isNotNull()).dropDuplicates(["row_id"])
    picked = s.orderBy(shuffle_key(F.col("row_id")), "row_id").limit(count)
    out = picked.withColumn("title", title(F.col("label"), F.col("predicted")))
    return out.withColumn("grid", to_grid(F.col("x"), height, width)) if "x" in s.columns else out


def epoch_lines(history: DataFrame, verbose: int = 1, samples: str | None = None) -> DataFrame:
    """(run_id, epoch, line_no, line): what training prints of an epoch.

    verbose 1 is the loss, the seconds and the batches; 2 adds accuracies of
    train and test rows; 3 also the batch losses in the array column named by
    `samples`. Other values raise an error. Lines with a null number are null.
    """
    if verbose not in (1, 2, 3):
        raise ValueError("verbose must be 1, 2 or 3")
    lines = [
        F.concat(
            F.lit("Epoch "), F.col("epoch").cast("string"), F.lit(" Loss: "), fixed(F.col("avg_loss"), 5), F.lit(" Time: "), fixed(F.col("seconds"), 1, "s"),
            F.lit(" Num batches: "), F.col("num_batches").cast("string"),
        )
    ]
    if verbose == 3 and samples:
        lines.append(F.concat(F.lit("Sample batch losses: ["), F.concat_ws(", ", F.transform(samples, lambda v: fixed(v, 5))), F.lit("]")))
    if verbose > 1:
        for name in ("Train", "Test"):
            acc, top = f"{name.lower()}_acc", f"{name.lower()}_top3"
            lines.append(F.concat(F.lit(f"{name}_acc "), fixed(F.col(acc), 5), F.lit(f", {name}_top_3_accuracy "), fixed(F.col(top), 5)))
    return history.select("run_id", "epoch", F.posexplode(F.array(*lines)).alias("line_no", "line"))
