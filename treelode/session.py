"""Session defaults. Cluster settings that are already set always win."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Oracle comparison and ISO timestamps both need UTC.
    "spark.sql.session.timeZone": "UTC",
    # Coalesces small and splits skewed shuffle partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("treelode")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TREELODE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    The archive goes out through Spark's own file distribution, once per context.
    """
    context = spark.sparkContext
    if getattr(context, "_treelode_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="treelode-")) / "treelode.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._treelode_shipped = True


def spread(frame: DataFrame) -> DataFrame:
    """Give a scan at least one task per core, for work that is heavy per row.

    A scan of many files or row groups already has more and is returned as it is, without a shuffle.
    `frame` must be a plain scan: counting its tasks must not run anything.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset and gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(context, "_treelode_folder", None) or tempfile.mkdtemp(prefix="treelode-shared-")
        context._treelode_folder = folder
    return folder.rstrip("/")


def settle(frame: DataFrame) -> DataFrame:
    """Compute a small frame that several branches read, once, into the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()
