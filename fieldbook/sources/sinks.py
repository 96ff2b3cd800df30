"""Writers with stable column order, and the scratch place round trips use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.plans.durable import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder: under the cluster's shared checkpoint folder, or a local one for a local session."""
    if spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        return tempfile.mkdtemp(prefix=f"fieldbook-{name}-") + "/data"
    return f"{checkpoint_dir(spark).rstrip('/')}/fieldbook-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it names."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV in the stated column order; arrays are flattened to ``a; b``, nulls stay empty."""
    types = dict(df.dtypes)
    cols = [F.concat_ws("; ", F.transform(c, lambda v: v.cast("string"))).alias(c) if types[c].startswith("array")
            else F.col(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """JSON lines in the stated column order, nulls written out so that unknown stays visible."""
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def split_outer_holes(rings: Column) -> tuple[Column, Column]:
    """Rings wound clockwise are outer rings, the others holes."""
    return (F.filter(rings, lambda r: geo.signed_area(r) < 0), F.filter(rings, lambda r: geo.signed_area(r) >= 0))


def _closed(r: Column) -> Column:
    return F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.array(r[0])))


def geojson_text(rings: Column, properties: Sequence[str]) -> Column:
    """A GeoJSON feature: one polygon per outer ring with the holes whose first vertex lies in it."""
    outer, holes = split_outer_holes(rings)
    polys = F.transform(outer, lambda o: F.concat(
        F.array(_closed(o)),
        F.transform(F.filter(holes, lambda h: geo.inside(h[0][0], h[0][1], F.array(o))), _closed)))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), polys.alias("coordinates")).alias("geometry")))


def write_geojson_lines(df: DataFrame, rings: str, properties: Sequence[str], path: str) -> None:
    """One feature per line, written in parallel."""
    df.select(geojson_text(F.col(rings), properties).alias("value")).write.mode("overwrite").text(path)


def cells_to_multipolygon(cells: DataFrame, key: str, x: str, y: str, size: float) -> DataFrame:
    """A mask of grid cells per key as squares of a MultiPolygon.

    Adjacent cells of a row are merged into one strip first (run-length by row), so the polygon list grows with the
    outline of the mask, not with its cells.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(key, y).orderBy(x)
    runs = (cells.select(key, x, y).distinct().withColumn("__r", F.col(x) - F.row_number().over(w))
            .groupBy(key, y, "__r").agg(F.min(x).alias("x0"), F.max(x).alias("x1")))
    pt = lambda a, b: F.array((a * size).cast("double"), (b * size).cast("double"))
    x0, x1, yy = F.col("x0"), F.col("x1") + 1, F.col(y)
    ring = F.array(pt(x0, yy), pt(x0, yy + 1), pt(x1, yy + 1), pt(x1, yy), pt(x0, yy))
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.array(ring))).alias("polygons"),
                                 F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"))
