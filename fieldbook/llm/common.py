"""What the training-data operators share: tables kept in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.plans.durable import checkpoint_dir

BROADCAST_ROWS = 1_000_000  # of rows of a few dozen bytes; larger sides are joined by a shuffle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Workspace:
    """Intermediate tables as Parquet under the shared checkpoint folder, so that a lost executor costs a read.

    A table that has been superseded is dropped at once; ``drop_all`` removes the rest when results are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, *partition: str) -> DataFrame:
        """Write ``df`` and return it as read again."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.kept_at)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for a broadcast if a count shows that it is within ``rows``; a larger one is left to a shuffle join.

    The result is the same either way. ``df`` should be a kept table of narrow rows, since it is counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
