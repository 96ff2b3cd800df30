"""Records spread over sheets, pages and nested levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.plans.ordered import running


def repair_spills(sheet: DataFrame, key: str, order: str, sheet_cols: Sequence[str]) -> DataFrame:
    """Give rows with a non-numeric key to the record before them.

    A line break in a free-text cell pushes the rest of a record onto the next row. Adds ``record`` (the numeric
    key the row belongs to) and ``spilled``. Rows with a blank key are dropped; order is by file position.
    """
    d = sheet.where(F.col(key).isNotNull() & (F.col(key) != ""))
    d = d.withColumn("__num", F.col(key).try_cast("long"))
    d = running(d, [], [order], None, {"record": ("last", "__num")})
    return d.withColumn("spilled", F.col("__num").isNull()).drop("__num").select(
        "record", "spilled", order, key, *sheet_cols).where(F.col("record").isNotNull())


def join_fragments(repaired: DataFrame, order: str, text_cols: Sequence[str]) -> DataFrame:
    """One text per record from its spilled rows, in file order (a record spills over a handful of rows)."""
    frag = F.concat_ws(" | ", *text_cols)
    return (repaired.where("spilled").groupBy("record")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), frag.alias("t")))).alias("f"))
            .select("record", F.concat_ws(" / ", F.transform("f", lambda x: x.t)).alias("continued"),
                    F.size("f").alias("fragments")))


def nest_sheets(sheets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with an array of row structs per sheet. A report's child rows are few by nature."""
    out = None
    for name, df in sheets.items():
        cols = [c for c in df.columns if c != key]
        g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = g if out is None else out.join(g, key, "full_outer")
    return out


def flatten_levels(df: DataFrame, keep: Sequence[str], levels: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Nested submissions to rows, level by level; a parent without children keeps one row with nulls.

    ``levels`` is a list of (array column, fields to lift); a field that is itself the next level is lifted too.
    """
    carried = list(keep)
    for arr, fields in levels:
        df = df.withColumn("__e", F.explode_outer(arr)).select(*carried, *[F.col(f"__e.{f}").alias(f) for f in fields])
        carried = [*carried, *[f for f in fields if f not in {a for a, _ in levels}]]
        nxt = [a for a, _ in levels if a in fields]
        df = df.select(*carried, *nxt)
    return df


def merge_pages(rows: DataFrame, search: str, declared: str, fields: Sequence[str], cap: int) -> DataFrame:
    """Per search: distinct rows over overlapping pages, the stated total, and whether it is capped or complete.

    Row identity is the content of ``fields`` in sorted order, so page overlap cannot count twice.
    """
    ident = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    once = rows.select(search, declared, ident.alias("__id")).distinct()
    g = once.groupBy(search).agg(F.count(F.lit(1)).alias("rows"), F.max(declared).alias("declared"))
    got = F.greatest("rows", F.coalesce("declared", F.lit(0)))
    return g.withColumn("capped", got >= cap).withColumn(
        "complete", ~F.col("capped") & (F.col("declared").isNull() | (F.col("rows") >= F.col("declared"))))


# Schema of a GeoJSON geometry, with coordinates kept as text until the type is known.
_GEOJSON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()),
                                            T.StructField("coordinates", T.StringType())])),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()),
                                                T.StructField("coordinates", T.StringType())])),
        T.StructField("properties", T.StringType())]))),
    T.StructField("properties", T.StringType()),
    T.StructField("coordinates", T.StringType()),
])
_RINGS = "array<array<array<double>>>"


def geojson_polygons(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """GeoJSON text (Feature, FeatureCollection or bare geometry) to one row per polygon with ring lists.

    MultiPolygons give one row per part (``part`` counts from 0); other geometry types give no row.
    """
    d = df.select(*keep, F.from_json(text, _GEOJSON).alias("g"))
    bare = F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))
    geoms = (F.when(F.col("g.type") == "FeatureCollection", F.transform("g.features", lambda f: F.struct(
        f.geometry.type.alias("type"), f.geometry.coordinates.alias("coordinates"))))
        .when(F.col("g.type") == "Feature", F.array(F.struct(F.col("g.geometry.type").alias("type"),
                                                              F.col("g.geometry.coordinates").alias("coordinates"))))
        .otherwise(F.array(bare)))
    d = d.select(*keep, F.posexplode(geoms).alias("feature", "geom"))
    polys = (F.when(F.col("geom.type") == "Polygon", F.array(F.from_json("geom.coordinates", _RINGS)))
             .when(F.col("geom.type") == "MultiPolygon", F.from_json("geom.coordinates", f"array<{_RINGS}>")))
    return d.select(*keep, "feature", F.posexplode(polys).alias("part", "rings"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON submissions with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)
