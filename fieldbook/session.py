"""Session helpers. Settings a job needs for right results are set here; sizing is left to the cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that change results, or that the operators rely on for skew handling.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldbook") -> SparkSession:
    """A local session for tests and benches. On a cluster use the session the platform gives."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in REQUIRED.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session somebody else built."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package once per context, wherever the job was started from.

    The archive is built beside the driver and handed to Spark, which copies it to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fieldbook_shipped", False):
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="fieldbook-package-")) / "fieldbook"
    sc.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
    sc._fieldbook_shipped = True
