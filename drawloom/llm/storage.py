"""Intermediate tables in the shared folder, removed when the driver's process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from drawloom.session import ensure_shared_dir

#: Setting under which the shuffle files of a query are removed when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a compressed table under spark.checkpoint.dir and read from there.

    Cuts the lineage like checkpoint(), in a tenth of the space for vectors; it
    outlives lost executors because the folder is shared. What was shuffled for
    it is freed at once and not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    atexit.register(remove, spark, path)
    return spark.read.parquet(path)


def busy(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores.

    Only inputs too small to be split further by their readers are moved; a
    large table has more partitions than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, rows: int, *keys: str, most: int = 16_384) -> DataFrame:
    """df partitioned by keys into enough tasks that each meets about `most` of its `rows` rows.

    A later groupBy on the same keys needs no further exchange, and the number is not merged away at run time.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // most)), *keys)


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner clears it then
        pass
