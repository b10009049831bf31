"""Accuracy and top-k accuracy, per evaluation or running over evaluations.

A row counts where it has a class id and a complete output; other rows are
left out of numerator and denominator. No such rows give a null accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawloom.functions.arrays import argmax, class_id, is_complete, rank_of


def scored(predictions: DataFrame, classes: int = 10, k: int = 3) -> DataFrame:
    """predictions with label, predicted, is_correct and in_top; all null where a row cannot be scored."""
    label = class_id(F.col("y"), classes)
    ok = is_complete(F.col("output"), classes) & label.isNotNull()
    out = predictions.withColumn("label", F.when(ok, label)).withColumn("predicted", F.when(ok, argmax(F.col("output"))))
    return out.withColumn("is_correct", F.col("label") == F.col("predicted")).withColumn(
        "in_top", F.when(F.col("label").isNotNull(), rank_of(F.col("output"), F.col("label")) < k)
    )


def accuracy(column: str = "is_correct"):
    return F.avg(F.col(column).cast("double"))


def composite(rows: DataFrame, *by: str) -> DataFrame:
    """Both metrics in one pass over scored rows, with the rows counted and left out."""
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count("label").alias("n_rows"),
        F.count_if(F.col("label").isNull()).alias("n_skipped"),
        accuracy("is_correct").alias("acc"),
        accuracy("in_top").alias("top3"),
    )


def cumulative(evals: DataFrame, *by: str) -> DataFrame:
    """Running blends over evaluations (eval_seq, n_rows, n_correct, n_top): a metric that is never reset."""
    w = Window.partitionBy(*by).orderBy("eval_seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n_rows").over(w)
    return evals.withColumn("run_acc", F.sum("n_correct").over(w) / n).withColumn("run_top3", F.sum("n_top").over(w) / n)
