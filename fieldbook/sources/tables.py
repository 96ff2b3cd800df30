"""Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.plans.skew import MOST_TASKS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``; zone-less timestamps become UTC timestamps (projected, so pushdown stays)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def text_table(spark: SparkSession, folder: str, name: str, key: str, task_mb: int | None = None) -> DataFrame:
    """A table of texts for costly per-text work, spread by key: a file with few row groups would be as few tasks.

    ``task_mb`` is for work that stays in these tasks to its end: so many MB of the files to a task, and none are merged.
    """
    df = table(spark, folder, name)
    if not task_mb:
        return df.repartition(key)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (task_mb << 20)))), key)
