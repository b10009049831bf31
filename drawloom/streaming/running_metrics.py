"""The metric that is never reset, as a keyless running aggregate over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators.metrics import scored
from drawloom.sources.tables import SCHEMAS


def predictions_stream(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files of a folder as a stream of predictions."""
    return spark.readStream.schema(SCHEMAS["predictions"]).parquet(path)


def running_accuracy(predictions: DataFrame) -> DataFrame:
    """acc and top3 over all rows so far; works on a stream (complete mode) and on a table alike.

    State is one row of four sums, whatever the stream's length.
    """
    s = scored(predictions)
    return s.groupBy().agg(
        F.count("label").alias("n_rows"),
        F.avg(F.col("is_correct").cast("double")).alias("acc"),
        F.avg(F.col("in_top").cast("double")).alias("top3"),
    )


def stream_to_table(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there now and returns its last state."""
    query = (
        running_accuracy(stream).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)
