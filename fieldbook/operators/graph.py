"""Records that are one thing: components over shared ids and short distances, and the merged record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.operators.spatial import radius_join
from fieldbook.plans.durable import durable


def shared_key_edges(bridge: DataFrame, record: str, key_cols: Sequence[str]) -> DataFrame:
    """One edge from each record to the least record of each key it holds: n - 1 edges per key, not n squared."""
    least = bridge.groupBy(*key_cols).agg(F.min(record).alias("b"))
    return (bridge.join(least, list(key_cols)).select(F.col(record).alias("a"), "b")
            .where(F.col("a") != F.col("b")).distinct())


def close_edges(points: DataFrame, record: str, lat: str, lon: str, group: str, radius_mi: float) -> DataFrame:
    """Edges that connect points of one group whenever they chain within ``radius_mi``.

    Points of a group in one small cell (diagonal at most the radius) hang on the cell's least record. Across cells
    only distinct places are compared, so thousands of records at one spot cost one comparison.
    """
    import math
    step = math.degrees(radius_mi / geo.RADIUS_MI) / math.sqrt(2) * (1 - 1e-6)
    p = (points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
         .select(F.col(record).alias("a"), F.col(group).alias("__g"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
         .withColumns({"__cy": F.floor(F.col("lat") / step), "__cx": F.floor(F.col("lon") / step)}))
    cell = p.groupBy("__g", "__cy", "__cx").agg(F.min("a").alias("b"))
    inside = p.join(cell, ["__g", "__cy", "__cx"]).select("a", "b").where(F.col("a") != F.col("b"))
    places = p.groupBy("__g", "__cy", "__cx", "lat", "lon").agg(F.min("a").alias("a"))
    left = places.select("a", F.col("__g"), "lat", "lon", "__cy", "__cx")
    right = places.select(F.col("a").alias("b"), "__g", F.col("lat").alias("rlat"),
                          F.col("lon").alias("rlon"), F.col("__cy").alias("__cy2"), F.col("__cx").alias("__cx2"))
    near = (radius_join(left, right, radius_mi, salt_by=["a"], also_on=["__g"])
            .where((F.col("a") > F.col("b"))
                   & ~((F.col("__cy") == F.col("__cy2")) & (F.col("__cx") == F.col("__cx2"))))
            .groupBy("__g", "__cy", "__cx", "__cy2", "__cx2").agg(F.min(F.struct("a", "b")).alias("e"))
            .select("e.a", "e.b"))
    return inside.unionByName(near).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", out: str = "component",
                         max_rounds: int = 60) -> DataFrame:
    """Component of every node, named by its least node (large-star / small-star alternation).

    Each round is two group-by-min steps with joins back; no neighbour list is ever collected. The rounds are
    cut by a reliable checkpoint and stop when the edges are stars, which a round would not change; running out of rounds
    is an error.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where(F.col("a") != F.col("b")).distinct())
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = _each(e, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (_each(large.join(least, "a"), ("b", "m"), ("a", "m"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct())
        e = durable(small)
    else:
        if not _are_stars(e):
            raise RuntimeError("components did not settle; raise max_rounds")
    best = e.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("__c"))
    return nodes.select(node).join(best, node, "left").select(node, F.coalesce("__c", node).alias(out))


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b) for each of the named pairs of columns of each row, in one pass."""
    both = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return df.select(F.explode(both).alias("e")).select("e.a", "e.b")


def _are_stars(e: DataFrame) -> bool:
    """Whether every ``a`` has one edge and no ``b`` is an ``a``."""
    ends = _each(e, ("a", "b"), ("b", "a")).select(
        F.col("a").alias("v"), (F.col("a") > F.col("b")).cast("int").alias("up"), (F.col("a") < F.col("b")).cast("int").alias("down"))
    per = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def merge_records(df: DataFrame, component: str, id_col: str, rank_by: Sequence, carry: Sequence[str],
                  list_cols: Sequence[str]) -> DataFrame:
    """One record per component: the best-ranked member's fields, the members, and each id list merged.

    ``list_cols`` are array columns; a component's distinct ids are bounded by one site's program ids.
    """
    best = F.max_by(F.struct(id_col, *carry), F.struct(*rank_by)).alias("__b")
    g = df.groupBy(component).agg(best, F.count(F.lit(1)).alias("members"))
    out = g.select(component, "members", F.col(f"__b.{id_col}").alias(id_col), *[F.col(f"__b.{c}") for c in carry])
    for c in list_cols:
        ids = (df.select(component, F.explode(c).alias("__v")).distinct().groupBy(component)
               .agg(F.array_sort(F.collect_list("__v")).alias(c)))
        out = out.join(ids, component, "left")
    return out


def nearest_group(parts: DataFrame, component: str, number: str, distance: str) -> DataFrame:
    """``parts`` (polygons) with ``kept`` and ``detached``: the component nearest to the point is kept, and so are the other
    parts of a parcel number that it holds, wherever they lie; those are ``detached``. A null number holds nothing."""
    best = parts.agg(F.min_by(component, F.struct(distance, component)).alias("__best"))
    core = parts.join(best, F.col(component) == F.col("__best"), "left_semi")
    held = core.select(F.col(number).alias("__number"), F.lit(True).alias("__held")).where(F.col("__number").isNotNull()).distinct()
    out = parts.join(best, F.col(component) == F.col("__best"), "left").join(held, F.col(number) == F.col("__number"), "left")
    near, also = F.col("__best").isNotNull(), F.col("__held").isNotNull()
    return out.withColumns({"kept": near | also, "detached": ~near & also}).drop("__best", "__number", "__held")
