"""Sessions and the shared folder that long jobs cut their lineage with."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "drawloom", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    A cluster names a folder that all executors share. Only where none is set
    (a local session in a test) a folder of this machine is made.
    """
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="drawloom-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the package to the workers once a context, however the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_drawloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="drawloom-py-"), "drawloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("drawloom", os.path.relpath(full, package)))
    context.addPyFile(path)
    context._drawloom_shipped = True
