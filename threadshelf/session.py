"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import threadshelf

# Functions of the package travel to the workers with the task, so that they need no install.
cloudpickle.register_pickle_by_value(threadshelf)

# Runtime settings only; sizes (memory, cores, shuffle partitions) belong to the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also split a skewed side when that costs one more shuffle after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # rows with whole texts: a batch is held by the JVM, in transit and by the Python worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "threadshelf", cores: int | str = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark, with a folder of its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="threadshelf-"))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Where it is not set, a folder in the warehouse, which all executors share as well.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/threadshelf-work"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named
