"""Session helpers: defaults for local work, and the one place that cuts lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "voxloom") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own session."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VOXLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only where none is configured (local tests) a scratch folder is chosen.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        )
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise a table outside executor memory so that a lost executor changes nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators with an Arrow kernel call this, so that executors need no installation and the
    driver's working folder does not matter.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-package-", dir="/tmp")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "voxloom"), "zip", root, "voxloom"))
    _SHIPPED.add(context.applicationId)
