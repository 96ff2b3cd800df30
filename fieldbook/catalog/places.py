"""Distances, polygons, routes, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.derive import (diamond, sql_coordinates, sql_haversine, sql_in_diamond, with_coordinates)
from fieldbook.catalog.registry import query
from fieldbook.functions import geo
from fieldbook.operators import graph, rollups, spatial
from fieldbook.sources import table

CENTER = (31.0, -91.0)
RADIUS = 150.0
_SUP = f"sup AS (SELECT *, {sql_coordinates('s_suppkey')} FROM supplier)"
_CUS = f"cus AS (SELECT *, {sql_coordinates('c_custkey')} FROM customer)"


def suppliers(spark, d):
    return with_coordinates(table(spark, d, "supplier"), "s_suppkey")


def customers(spark, d):
    return with_coordinates(table(spark, d, "customer"), "c_custkey")


_NEAR = f"""near AS (SELECT *, {sql_haversine(CENTER[0], CENTER[1], 'lat', 'lon')} AS dist FROM sup)"""
_RELEASES = """facts AS (SELECT l.*, n.s_name, n.dist, l_quantity AS onsite,
  CASE WHEN l_returnflag = 'A' THEN l_quantity * 0.5 ELSE 0 END AS air
  FROM lineitem l JOIN near n ON l.l_suppkey = n.s_suppkey WHERE n.dist <= 150.0)"""


def releases(spark, d):
    """Line items as filings: quantity is the release, flag R is a short form (no quantity disclosed), status O is
    in grams, flag A goes half to air, discounts above 0.05 mark the flagged substances."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("facility"), F.col("l_partkey").alias("chemical"), F.col("l_quantity").alias("onsite"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 0.5).otherwise(0.0).alias("air"),
        (F.col("l_returnflag") == "R").alias("short_form"), (F.col("l_linestatus") == "O").alias("grams"),
        (F.col("l_discount") > 0.05).alias("flagged"), F.year("l_shipdate").alias("year"))


@query("a2_radius_rollup_by_facility", f"""
WITH {_SUP}, {_NEAR}, {_RELEASES}
SELECT l_suppkey AS facility, any_value(s_name) AS name, round(any_value(dist), 6) AS distance_mi,
  round(coalesce(sum(onsite) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O'), 0), 2) AS onsite_lb,
  round(coalesce(sum(air) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O'), 0), 2) AS air_lb,
  round(coalesce(sum(onsite) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O' AND l_discount > 0.05), 0), 2)
    AS flagged_lb,
  round(coalesce(sum(onsite) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'), 0), 2) AS onsite_g,
  count(*) FILTER (l_returnflag = 'R') AS short_forms,
  count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS chemicals
FROM facts GROUP BY l_suppkey""")
def a2_facility(spark, d):
    """Flagship: everything released within 150 miles of a point, per facility, pounds and grams apart."""
    return rollups.radius_rollup(releases(spark, d), suppliers(spark, d), CENTER, RADIUS, "facility", "s_suppkey",
                                 "s_name", "chemical", by="facility")


@query("a2_radius_rollup_by_chemical", f"""
WITH {_SUP}, {_NEAR}, {_RELEASES}
SELECT l_partkey AS chemical,
  round(coalesce(sum(onsite) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O'), 0), 2) AS onsite_lb,
  round(coalesce(sum(air) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O'), 0), 2) AS air_lb,
  round(coalesce(sum(onsite) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'), 0), 2) AS onsite_g,
  count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS facilities,
  count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS short_form_facilities
FROM facts GROUP BY l_partkey
HAVING count(*) FILTER (l_returnflag = 'R') > 0 OR count(*) FILTER (l_linestatus <> 'O') > 0""")
def a2_chemical(spark, d):
    return rollups.radius_rollup(releases(spark, d), suppliers(spark, d), CENTER, RADIUS, "facility", "s_suppkey",
                                 "s_name", "chemical", by="chemical")


@query("f1_great_circle_distance", f"""
WITH {_CUS} SELECT c_custkey, round({sql_haversine(31.0, -91.0, 'lat', 'lon')}, 6) AS mi,
 round({sql_haversine(31.0, -91.0, 'lat', 'lon', 6371.0)}, 6) AS km,
 round({sql_haversine(31.0, -91.0, 'lat', 'lon', 6371.0088)}, 6) AS km_mean FROM cus""")
def f1(spark, d):
    m = lambda r: F.round(geo.haversine(31.0, -91.0, "lat", "lon", r), 6)
    return customers(spark, d).select("c_custkey", m(geo.RADIUS_MI).alias("mi"), m(geo.RADIUS_KM).alias("km"),
                                      m(geo.RADIUS_KM_MEAN).alias("km_mean"))


@query("f2_bearing_and_angle", f"""
WITH {_CUS}, b AS (SELECT c_custkey, degrees(atan2(sin(radians(lon + 91.0)) * cos(radians(lat)),
  cos(radians(31.0)) * sin(radians(lat)) - sin(radians(31.0)) * cos(radians(lat)) * cos(radians(lon + 91.0)))) AS t
  FROM cus), c AS (SELECT c_custkey, CASE WHEN t < 0 THEN t + 360 ELSE t END AS br FROM b)
SELECT c_custkey, round(br, 6) AS bearing, round(least(abs(br - 315.0), 360 - abs(br - 315.0)), 6) AS off_nw FROM c""")
def f2(spark, d):
    return customers(spark, d).withColumn("b", geo.bearing(31.0, -91.0, "lat", "lon")).select(
        "c_custkey", F.round("b", 6).alias("bearing"), F.round(geo.angle_difference("b", F.lit(315.0)), 6)
        .alias("off_nw"))


@query("f2_direction_spread_and_axis", """
WITH e AS (SELECT user_id, (value * 7.3) % 360 AS a FROM events),
g AS (SELECT user_id, a, lead(a) OVER w AS nx, first_value(a) OVER w AS f FROM (SELECT DISTINCT * FROM e)
  WINDOW w AS (PARTITION BY user_id ORDER BY a)),
s AS (SELECT user_id, 360 - max(coalesce(nx - a, f + 360 - a)) AS spread FROM g GROUP BY 1),
x AS (SELECT user_id, avg(sin(radians(2 * a))) AS sn, avg(cos(radians(2 * a))) AS cs, count(*) AS n FROM e GROUP BY 1)
SELECT user_id, round(spread, 6) AS spread, n, round(sqrt(sn * sn + cs * cs), 6) AS axial_strength
FROM s JOIN x USING (user_id)""")
def f2_spread(spark, d):
    ev = table(spark, d, "events").select("user_id", (F.col("value") * 7.3 % 360).alias("a"))
    return rollups.direction_spread(ev, ["user_id"], "a").select(
        "user_id", F.round("spread", 6).alias("spread"), "n", F.round("axial_strength", 6).alias("axial_strength"))


def _albers_sql():
    import math
    f = geo.GRS80_F
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(s):
        return f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - {1 / (2 * e)!r} * ln((1 - {e!r} * {s}) / (1 + {e!r} * {s}))))"
    qn = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2)
                               - 1 / (2 * e) * math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))))
    mn = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p1, p2, p0 = map(math.radians, (29.5, 45.5, 23.0))
    n = (mn(p1) ** 2 - mn(p2) ** 2) / (qn(p2) - qn(p1))
    c = mn(p1) ** 2 + n * qn(p1)
    rho0 = geo.GRS80_A * math.sqrt(c - n * qn(p0)) / n
    return f"""SELECT c_custkey, {geo.GRS80_A!r} * sqrt({c!r} - {n!r} * {q('sin(radians(lat))')}) / {n!r} AS rho,
      {n!r} * radians(lon + 96.0) AS th, {rho0!r} AS rho0 FROM cus"""


@query("f3_equal_area_grid_cell", f"""
WITH {_CUS}, p AS ({_albers_sql()})
SELECT c_custkey, round_even(rho * sin(th) / 810.0, 0)::BIGINT AS cell_x,
  round_even((rho0 - rho * cos(th)) / 810.0, 0)::BIGINT AS cell_y, round(rho * sin(th), 3) AS x_m FROM p""")
def f3(spark, d):
    cx, cy = geo.grid_cell("lat", "lon")
    return customers(spark, d).select("c_custkey", cx.alias("cell_x"), cy.alias("cell_y"),
                                      F.round(geo.albers("lat", "lon")[0], 3).alias("x_m"))


@query("f3_utm_and_local_metres", f"""
WITH {_CUS}, s AS (SELECT *, (floor((lon + 180) / 6) + 1)::BIGINT AS zone, sin(radians(lat)) AS s FROM cus),
k AS (SELECT *, {geo.GRS80_F!r} / (2 - {geo.GRS80_F!r}) AS n, sqrt({geo.GRS80_F!r} * (2 - {geo.GRS80_F!r})) AS e,
  radians(lon - (zone * 6 - 183)) AS lam FROM s),
t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM k),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta,
  {geo.GRS80_A!r} / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS aa FROM t),
v AS (SELECT *, n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 AS a1,
  13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 AS a2, 61 * n**3 / 240 - 103 * n**4 / 140 AS a3,
  49561 * n**4 / 161280 AS a4 FROM u)
SELECT c_custkey, zone,
  round(500000 + 0.9996 * aa * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta)
    + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS easting,
  round(0.9996 * aa * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta)
    + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS northing,
  round((lat - 30.0) * (111132.954 - 559.822 * cos(2 * radians(30.0)) + 1.175 * cos(4 * radians(30.0))), 3) AS local_y
FROM v""")
def f3_utm(spark, d):
    z, e, n = geo.utm("lat", "lon")
    ly = geo.local_metres("lat", "lon", 30.0, -91.0)[1]
    return customers(spark, d).select("c_custkey", z.alias("zone"), F.round(e, 3).alias("easting"),
                                      F.round(n, 3).alias("northing"), F.round(ly, 3).alias("local_y"))


@query("f4_polygon_area_and_interior_point", """
WITH n AS (SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey * 10.0::DOUBLE AS x, n_nationkey * 5.0::DOUBLE AS y,
  8.0::DOUBLE + n_nationkey AS h FROM nation)
SELECT n_nationkey, round(2 * h * h - (h / 2) * (h / 2), 6) AS area,
  (abs(px - x) + abs(py - y) < h AND NOT (abs(px - x) < h / 4 AND abs(py - y) < h / 4)) AS interior_inside
FROM (SELECT *, x - h * 0.5 AS px, y AS py FROM n)""")
def f4(spark, d):
    return nation_shapes(spark, d).withColumn("p", geo.interior_point(F.col("rings"))).select(
        "n_nationkey", F.round(geo.area(F.col("rings")), 6).alias("area"),
        geo.inside("p.x", "p.y", F.col("rings")).alias("interior_inside"))


def nation_shapes(spark, d, dx=0.0, dy=0.0):
    """A diamond with a hole per nation, in a planar frame."""
    k = F.col("n_nationkey").cast("double")
    return table(spark, d, "nation").select("n_nationkey", (k * 10 + dx).alias("x0"),
                                            (k * 5 + dy).alias("y0"), (k + 8).alias("h")).withColumn(
        "rings", diamond(F.col("x0"), F.col("y0"), F.col("h")))


_SHAPES = """shp AS (SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey * 10.0::DOUBLE AS x0,
 n_nationkey * 5.0::DOUBLE AS y0, n_nationkey + 8.0::DOUBLE AS h FROM nation)"""
_PTS = """pts AS (SELECT c_custkey, (c_custkey * 7919 % 26003) / 100.0::DOUBLE AS px,
 (c_custkey * 6271 % 14009) / 100.0::DOUBLE AS py, c_acctbal FROM customer)"""


def planar_customers(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(26003)) / 100.0).alias("px"),
        (F.pmod(F.col("c_custkey") * 6271, F.lit(14009)) / 100.0).alias("py"), "c_acctbal", "c_nationkey")


@query("f5_degrees_minutes_seconds", """
SELECT o_orderkey, CASE WHEN v = 0 THEN NULL ELSE round(v * sg, 8) END AS decimal_degrees FROM (
 SELECT o_orderkey, (o_orderkey % 90) + (o_orderkey % 60) / 60.0::DOUBLE + (o_orderkey % 59) / 3600.0::DOUBLE AS v,
  CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS sg FROM orders)""")
def f5(spark, d):
    k = F.col("o_orderkey")
    q = F.when(F.col("o_orderstatus") == "F", "W").otherwise("E")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(geo.dms(k % 90, k % 60, k % 59, q), 8).alias("decimal_degrees"))


@query("p7_envelope_prefilter", f"""
WITH {_CUS} SELECT c_custkey, round(dist, 6) AS distance_mi FROM (
 SELECT c_custkey, {sql_haversine(31.0, -91.0, 'lat', 'lon')} AS dist FROM cus) WHERE dist <= 25""")
def p7(spark, d):
    s, n, w, e = geo.degree_box(31.0, -91.0, 25.0)
    return (customers(spark, d).where(F.col("lat").between(s, n) & F.col("lon").between(w, e))
            .withColumn("dist", geo.haversine(31.0, -91.0, "lat", "lon")).where("dist <= 25")
            .select("c_custkey", F.round("dist", 6).alias("distance_mi")))


@query("p8_longitude_sign_repair", f"""
WITH {_CUS}, raw AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -lon ELSE lon END AS lon,
  CASE WHEN c_custkey % 7 = 0 THEN 'GU' ELSE 'LA' END AS state FROM cus)
SELECT c_custkey, round(CASE WHEN lon > 0 AND state <> 'GU' THEN -lon ELSE lon END, 6) AS lon_fixed,
  (lon > 0 AND state <> 'GU') AS flipped FROM raw""")
def p8(spark, d):
    k = F.col("c_custkey")
    raw = customers(spark, d).select(k, F.when(k % 3 == 0, -F.col("lon")).otherwise(F.col("lon")).alias("lon"),
                                     F.when(k % 7 == 0, "GU").otherwise("LA").alias("state"))
    lon, flipped = geo.repair_longitude("lon", "state")
    return raw.select("c_custkey", F.round(lon, 6).alias("lon_fixed"), flipped.alias("flipped"))


@query("j9_radius_join", f"""
WITH {_SUP}, {_CUS}, j AS (SELECT c.c_custkey, s.s_suppkey, {sql_haversine('s.lat', 's.lon', 'c.lat', 'c.lon')} AS dist
 FROM cus c, sup s) SELECT c_custkey, s_suppkey, round(dist, 6) AS distance_mi FROM j WHERE dist <= 12""")
def j9(spark, d):
    sup = with_coordinates(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "rlat", "rlon")
    cus = customers(spark, d).select("c_custkey", "lat", "lon")
    return spatial.radius_join(cus, sup, 12.0, salt_by=["c_custkey"]).select(
        "c_custkey", "s_suppkey", F.round("distance", 6).alias("distance_mi"))


@query("j10_nearest_within_cap", f"""
WITH {_SUP}, {_CUS}, j AS (SELECT c.c_custkey, s.s_suppkey, {sql_haversine('c.lat', 'c.lon', 's.lat', 's.lon')} AS dist
 FROM cus c, sup s), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, s_suppkey) AS rn FROM j)
SELECT c_custkey, CASE WHEN dist <= 15 THEN s_suppkey END AS s_suppkey,
 CASE WHEN dist <= 15 THEN round(dist, 6) END AS distance_mi, dist > 15 AS gap FROM r WHERE rn = 1""")
def j10(spark, d):
    sup = with_coordinates(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "rlat", "rlon")
    cus = customers(spark, d).select("c_custkey", "lat", "lon")
    return spatial.nearest_join(cus, sup, "c_custkey", ["s_suppkey"], 15.0).select(
        "c_custkey", "s_suppkey", F.round("distance", 6).alias("distance_mi"),
        F.col("distance").isNull().alias("gap"))


@query("j12_point_in_polygon", f"""
WITH {_SHAPES}, {_PTS} SELECT c_custkey, n_nationkey FROM pts, shp
WHERE {sql_in_diamond('px', 'py', 'x0', 'y0', 'h')}""")
def j12(spark, d):
    return spatial.point_in_polygon(planar_customers(spark, d), nation_shapes(spark, d), "px", "py", "rings", 16.0,
                                    ["c_custkey"]).select("c_custkey", "n_nationkey")


@query("j13_polygon_distance_bands", f"""
WITH {_SHAPES}, {_PTS}, q AS (SELECT *, abs(px - x0) AS u, abs(py - y0) AS v FROM pts, shp),
m AS (SELECT c_custkey, n_nationkey, CASE WHEN {sql_in_diamond('px', 'py', 'x0', 'y0', 'h')} THEN 0
 WHEN u < h / 4 AND v < h / 4 THEN least(h / 4 - u, h / 4 - v)
 ELSE sqrt(pow(u - greatest(0, least(h, (u - v + h) / 2)), 2)
         + pow(v - (h - greatest(0, least(h, (u - v + h) / 2))), 2)) END AS dist FROM q)
SELECT n_nationkey, count(*) AS total, count(*) FILTER (dist = 0) AS inside,
 count(*) FILTER (dist <= 2) AS within_2, count(*) FILTER (dist <= 5) AS within_5 FROM m WHERE dist <= 5 GROUP BY 1""")
def j13(spark, d):
    near = spatial.polygon_distance_join(planar_customers(spark, d), nation_shapes(spark, d), "px", "py", "rings",
                                         5.0, ["c_custkey"])
    return spatial.distance_bands(near, ["n_nationkey"], "distance", [2.0, 5.0]).drop("nearest")


@query("j13_polygon_pairs_within_gap", """
WITH s AS (SELECT n_nationkey::BIGINT AS k, n_nationkey * 10.0::DOUBLE AS x, n_nationkey * 5.0::DOUBLE AS y,
  2.0 + (n_nationkey % 3) AS h FROM nation),
-- axis-aligned squares: the gap of two boxes in closed form
p AS (SELECT a.k AS shape_a, b.k AS shape_b, greatest(0, abs(a.x - b.x) - a.h - b.h) AS gx,
  greatest(0, abs(a.y - b.y) - a.h - b.h) AS gy FROM s a, s b WHERE a.k < b.k)
SELECT shape_a, shape_b, round(sqrt(gx * gx + gy * gy), 6) AS gap FROM p WHERE gx * gx + gy * gy <= 25""")
def j13_pairs(spark, d):
    a, b = squares(spark, d, "shape_a", "rings_a"), squares(spark, d, "shape_b", "rings_b")
    j = spatial.polygon_pairs_within(a, b, "rings_a", "rings_b", "shape_a", "shape_b", 5.0, 10.0)
    return j.where("shape_a < shape_b").select("shape_a", "shape_b", F.round("gap", 6).alias("gap"))


def squares(spark, d, name, rings):
    k = F.col("n_nationkey").cast("double")
    h = F.lit(2.0) + F.col("n_nationkey") % 3
    x, y = k * 10, k * 5
    pt = lambda a, b: F.array(a, b)
    ring = F.array(pt(x - h, y - h), pt(x - h, y + h), pt(x + h, y + h), pt(x + h, y - h))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias(name), F.array(ring).alias(rings))


@query("j14_overlap_by_sampling", """
WITH s AS (SELECT n_nationkey::BIGINT AS parcel, n_nationkey * 10.0::DOUBLE AS x, n_nationkey * 5.0::DOUBLE AS y,
  2.0 + (n_nationkey % 3) AS h FROM nation),
z AS (SELECT n_nationkey::BIGINT AS zone, n_nationkey * 10.0::DOUBLE + 0.0137 AS x,
  n_nationkey * 5.0::DOUBLE + 0.0071 AS y, n_nationkey + 8.0::DOUBLE AS h FROM nation),
g AS (SELECT parcel, h, x - h + 2 * h * (i + 0.5) / 20 AS px, y - h + 2 * h * (j + 0.5) / 20 AS py
  FROM s, range(20) a(i), range(20) b(j)),
m AS (SELECT parcel, zone, count(*) AS hits, any_value(g.h) AS ph FROM g, z
  WHERE abs(px - z.x) + abs(py - z.y) < z.h AND NOT (abs(px - z.x) < z.h / 4 AND abs(py - z.y) < z.h / 4)
  GROUP BY 1, 2)
SELECT parcel, zone, hits, round(hits / 400.0, 6) AS share, round(hits / 400.0 * 4 * ph * ph, 6) AS covered_area
FROM m""")
def j14(spark, d):
    layer = nation_shapes(spark, d, 0.0137, 0.0071).select(F.col("n_nationkey").alias("zone"), F.col("rings").alias("zone_rings"))
    o = spatial.overlap_shares(squares(spark, d, "parcel", "rings"), layer, "parcel", "rings", "zone", "zone_rings",
                               400, 16.0)
    return o.select("parcel", "zone", "hits", F.round("share", 6).alias("share"),
                    F.round("covered_area", 6).alias("covered_area"))


@query("o4_layer_set_operations", f"""
WITH {_PTS}, f AS (SELECT c_custkey, px < 150 AS in_state, py < 80 AS in_other FROM pts)
SELECT count(*) AS points, count(*) FILTER (in_state OR in_other) AS either,
 count(*) FILTER (in_state AND in_other) AS both_layers, count(*) FILTER (in_state AND NOT in_other) AS state_only,
 round(count(*) FILTER (in_state AND NOT in_other) * 36427.0 / count(*), 6) AS state_only_area FROM f""")
def o4(spark, d):
    p = planar_customers(spark, d).select((F.col("px") < 150).alias("a"), (F.col("py") < 80).alias("b"))
    return rollups.layer_areas(p, "a", "b", 36427.0).select(
        "points", "either", F.col("both").alias("both_layers"), F.col("a_only").alias("state_only"),
        F.round("a_only_area", 6).alias("state_only_area"))


_LINE = """v AS (SELECT n_nationkey::BIGINT AS i, n_nationkey * 10.0::DOUBLE AS x,
   (n_nationkey * 7 % 11) * 3.0::DOUBLE AS y FROM nation),
 g AS (SELECT i + 1 AS seg, x AS x1, y AS y1, lead(x) OVER (ORDER BY i) AS x2, lead(y) OVER (ORDER BY i) AS y2 FROM v),
 s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM g WHERE x2 IS NOT NULL),
 c AS (SELECT *, sum(len) OVER (ORDER BY seg) - len AS m0 FROM s)"""


@query("j15_downstream_within_buffer", f"""
WITH {_PTS}, {_LINE},
t AS (SELECT c_custkey, seg, m0, len, x1, y1, x2, y2, px, py, greatest(0, least(1,
  ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM pts, c),
o AS (SELECT c_custkey, seg, m0 + t * len AS along, sqrt(pow(x1 + t * (x2 - x1) - px, 2)
  + pow(y1 + t * (y2 - y1) - py, 2)) AS off FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY off, seg) AS rn FROM o WHERE off <= 6)
SELECT c_custkey, round(along, 6) AS along_m, round(off, 6) AS off_m, round(along - 100, 6) AS downstream_m
FROM b WHERE rn = 1 AND along >= 100""")
def j15(spark, d):
    k = F.col("n_nationkey")
    # the route itself is one small object: its vertices are gathered in order (25 of them)
    line = table(spark, d, "nation").select(F.struct(k.alias("i"), F.array(
        k * 10.0, (k * 7 % 11) * 3.0).alias("p")).alias("v"), "n_name").agg(
        F.sort_array(F.collect_list("v")).alias("vs"), F.min("n_name").alias("line")).select("line", F.transform("vs", lambda v: v.p).alias("coords"))
    segs = spatial.line_segments(line, "line", "coords")
    loc = spatial.locate_on_line(planar_customers(spark, d), segs, "c_custkey", "px", "py", "line", 6.0)
    start = line.select("line", F.lit(100.0).alias("outfall_m"))
    return spatial.downstream(loc, start, "line", "outfall_m").select(
        "c_custkey", *[F.round(c, 6).alias(c) for c in ("along_m", "off_m", "downstream_m")])


@query("j15_second_route", f"""
WITH RECURSIVE {_PTS}, v AS (SELECT n_nationkey::BIGINT AS i, n_nationkey * 10.0::DOUBLE AS x, (n_nationkey * 7 % 11) * 3.0::DOUBLE AS y FROM nation),
g AS (SELECT (a.i - 2) // 4 * 4 + 2 AS reach, (a.i - 2) // 4 * 4 + 2 AS head, (a.i - 2) // 4 * 4 + 6 AS tail, 1 AS route, (a.i - 2) % 4 + 1 AS seg, a.x AS x1, a.y AS y1,
  b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.i = a.i + 1 WHERE a.i >= 2
 UNION ALL SELECT 100 + i, i, 100 + i, 2, 1, x, y, x + 4, y + 30 FROM v WHERE i % 4 = 2 UNION ALL SELECT 100 + i, i, 100 + i, 2, 2, x + 4, y + 30, x + 9, y + 60 FROM v WHERE i % 4 = 2
 UNION ALL SELECT 200 + i, 100 + i, 200 + i, 2, 1, x + 9, y + 60, x + 2, y + 100 FROM v WHERE i % 4 = 2),
s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM g), e AS (SELECT reach, head, tail, sum(len) AS len FROM s GROUP BY 1, 2, 3),
w(node, m) AS (SELECT 6::BIGINT, 0.0::DOUBLE UNION ALL SELECT tail, m + len FROM w JOIN e ON head = node),
c AS (SELECT s.*, m + sum(len) OVER (PARTITION BY reach ORDER BY seg) - len AS m0 FROM s JOIN w ON node = head),
t AS (SELECT c_custkey, route, reach, seg, m0, len, x1, y1, x2, y2, px, py, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) /
 (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM pts, c),
o AS (SELECT c_custkey, route, reach, seg, m0 + t * len AS along, sqrt(pow(x1 + t * (x2 - x1) - px, 2) + pow(y1 + t * (y2 - y1) - py, 2)) AS off FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, route ORDER BY off, reach, seg) AS rn FROM o WHERE off <= 6),
f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY route) AS first FROM b WHERE rn = 1 AND along >= 0)
SELECT c_custkey, route::BIGINT AS route, round(along, 6) AS along_m, round(off, 6) AS off_m FROM f WHERE first = 1""")
def j15_b(spark, d):
    """Customers downstream of the second fork by the main line, else by a branch that leaves it.

    A reach of the main line runs from fork to fork, five vertices at most.
    """
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").where(k >= 2).select(k.cast("long").alias("i"), (k * 10.0).alias("x"), (k * 7 % 11 * 3.0).alias("y"))
    own = F.floor((F.col("i") - 2) / 4) * 4 + 2
    main = n.select("i", F.array("x", "y").alias("p"), F.explode(F.when(F.col("i") == own, F.array(own, own - 4)).otherwise(
        F.array(own))).alias("reach")).groupBy("reach").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("vs")).where("reach >= 2").select(
        "reach", F.col("reach").alias("head"), (F.col("reach") + 4).alias("tail"), F.lit(1).alias("route"), F.transform("vs", lambda v: v.p).alias("coords"))
    at = lambda dx, dy: F.array(F.col("x") + float(dx), F.col("y") + float(dy))
    branch = lambda reach, head, *path: n.where("i % 4 = 2").select(
        (F.col("i") + reach).alias("reach"), (F.col("i") + head).alias("head"), (F.col("i") + reach).alias("tail"), F.lit(2).alias("route"),
        F.array(*path).alias("coords"))
    reaches = main.unionByName(branch(100, 0, at(0, 0), at(4, 30), at(9, 60))).unionByName(branch(200, 100, at(9, 60), at(2, 100)))
    steps = F.transform(F.sequence(F.lit(1), F.size("coords") - 1), lambda j: F.hypot(
        F.element_at("coords", j + 1)[0] - F.element_at("coords", j)[0], F.element_at("coords", j + 1)[1] - F.element_at("coords", j)[1]))
    edges = reaches.withColumn("length", F.aggregate(steps, F.lit(0.0), lambda a, b: a + b))
    m = spatial.route_metres(edges, spark.range(6, 7).select(F.col("id").alias("node"), F.lit(0.0).alias("m")), "reach", "head", "tail", "length")
    return spatial.along_routes(planar_customers(spark, d), reaches, m, "c_custkey", "px", "py", "reach", "coords", "route", 6.0).select(
        "c_custkey", F.col("route").cast("long").alias("route"), F.round("along_m", 6).alias("along_m"), F.round("off_m", 6).alias("off_m"))


@query("j28_at_point_or_within_radius", f"""
WITH {_SHAPES}, {_PTS}, q AS (SELECT *, abs(px - x0) AS u, abs(py - y0) AS v FROM pts, shp),
m AS (SELECT c_custkey, n_nationkey, CASE WHEN {sql_in_diamond('px', 'py', 'x0', 'y0', 'h')} THEN 0
 WHEN u < h / 4 AND v < h / 4 THEN least(h / 4 - u, h / 4 - v)
 ELSE sqrt(pow(u - greatest(0, least(h, (u - v + h) / 2)), 2)
         + pow(v - (h - greatest(0, least(h, (u - v + h) / 2))), 2)) END AS dist FROM q),
a AS (SELECT c_custkey, count(*) FILTER (dist = 0) AS at_point, count(*) FILTER (dist > 0 AND dist <= 4) AS nearby
  FROM m GROUP BY 1)
SELECT c_custkey, at_point, nearby, CASE WHEN at_point > 0 THEN 'designated' WHEN nearby > 0 THEN 'nearby'
  ELSE 'none' END AS status FROM a""")
def j28(spark, d):
    pts = planar_customers(spark, d)
    near = spatial.polygon_distance_join(pts, nation_shapes(spark, d), "px", "py", "rings", 4.0, ["c_custkey"])
    return rollups.point_status(pts.select("c_custkey"), near, "c_custkey", "distance")


@query("a18_distance_bands", f"""
WITH {_SUP}, {_CUS}, j AS (SELECT s.s_suppkey, {sql_haversine('c.lat', 'c.lon', 's.lat', 's.lon')} AS dist
 FROM cus c, sup s), k AS (SELECT * FROM j WHERE dist <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist) AS rn FROM k)
SELECT s_suppkey, count(*) AS total, count(*) FILTER (dist = 0) AS inside, count(*) FILTER (dist <= 5) AS within_5,
 count(*) FILTER (dist <= 10) AS within_10, count(*) FILTER (dist <= 20) AS within_20,
 string_agg(printf('%.3f', round(dist, 3)), ', ' ORDER BY dist) FILTER (rn <= 5) AS nearest FROM r GROUP BY 1""")
def a18(spark, d):
    sup = with_coordinates(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "rlat", "rlon")
    cus = customers(spark, d).select("c_custkey", "lat", "lon")
    j = spatial.radius_join(cus, sup, 20.0, salt_by=["c_custkey"], bands=[5.0, 10.0, 20.0])
    return spatial.distance_bands(j, ["s_suppkey"], "distance", [5.0, 10.0, 20.0])


@query("a23_neighbourhood_range", """
WITH c AS (SELECT user_id % 40 AS x, (event_id * 7 % 30)::BIGINT AS y, round(sum(value), 4) AS v FROM events GROUP BY 1, 2),
o AS (SELECT a.x, a.y, any_value(a.v) AS v, count(*) AS n, min(b.v) AS lo, max(b.v) AS hi FROM c a JOIN c b
 ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y)
SELECT x, y, v, CASE WHEN n < 9 THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN n < 9 THEN greatest(hi, 0) ELSE hi END
 AS hi FROM o""")
def a23(spark, d):
    c = (table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("x"), (F.col("event_id") * 7 % 30).alias("y"))
         .agg(F.round(F.sum("value"), 4).alias("v")))
    return spatial.neighbourhood_range(c, [], "x", "y", "v")


_SITES = f"""site AS (SELECT c_custkey AS id, {sql_coordinates('c_custkey')}, split_part('ALPHA BRAVO CARGO', ' ',
  (c_custkey % 3 + 1)::INT) AS tok, c_custkey // 3 * 5 % 900 AS pid, c_nationkey, c_acctbal FROM customer)"""


def sites(spark, d):
    k = F.col("c_custkey")
    return with_coordinates(table(spark, d, "customer"), "c_custkey").withColumns({
        "id": k, "tok": F.element_at(F.array(F.lit("ALPHA"), F.lit("BRAVO"), F.lit("CARGO")), (k % 3 + 1).cast("int")),
        "pid": F.floor(k / 3) * 5 % 900})


_COMP = f"""WITH RECURSIVE {_SITES},
e AS (SELECT a.id AS a, b.id AS b FROM site a JOIN site b ON a.id <> b.id AND (a.pid = b.pid OR (a.tok = b.tok AND
  {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1.0))),
r AS (SELECT id AS n, id AS c FROM site UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b),
comp AS (SELECT n AS id, min(c) AS component FROM r GROUP BY 1)"""


def site_components(spark, d):
    s = sites(spark, d)
    edges = graph.shared_key_edges(s.select("id", "pid"), "id", ["pid"]).unionByName(
        graph.close_edges(s, "id", "lat", "lon", "tok", 1.0))
    return graph.connected_components(s.select("id"), edges)


@query("g1_connected_components", _COMP + " SELECT id, component FROM comp")
def g1(spark, d):
    """Records sharing a program id, or within a mile under the same leading name word."""
    return site_components(spark, d)


@query("g2_parcel_groups", """
WITH RECURSIVE s AS (SELECT n_nationkey::BIGINT AS k, n_nationkey * 10.0::DOUBLE AS x, n_nationkey * 5.0::DOUBLE AS y,
  2.0 + (n_nationkey % 3) AS h FROM nation),
e AS (SELECT a.k AS a, b.k AS b FROM s a, s b WHERE a.k <> b.k AND pow(greatest(0, abs(a.x - b.x) - a.h - b.h), 2)
  + pow(greatest(0, abs(a.y - b.y) - a.h - b.h), 2) <= 16),
r AS (SELECT k AS n, k AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b),
g AS (SELECT n AS parcel, min(c) AS component FROM r GROUP BY 1),
dd AS (SELECT component, min(sqrt(pow(greatest(0, abs(x - 101.0) - h), 2) + pow(greatest(0, abs(y - 52.0) - h), 2)))
  AS dist FROM g JOIN s ON s.k = g.parcel GROUP BY 1)
SELECT parcel, component, component = (SELECT component FROM dd ORDER BY dist, component LIMIT 1) AS kept FROM g""")
def g2(spark, d):
    """Parcels chained by gaps of at most 4; the group nearest to a point is the one kept."""
    a, b = squares(spark, d, "a", "rings_a"), squares(spark, d, "b", "rings_b")
    e = spatial.polygon_pairs_within(a, b, "rings_a", "rings_b", "a", "b", 4.0, 10.0).where("a < b").select("a", "b")
    p = squares(spark, d, "parcel", "rings")
    comp = graph.connected_components(p, e, "parcel")
    dist = comp.join(p, "parcel").withColumn("d", geo.ring_distance(101.0, 52.0, F.col("rings")))
    best = dist.agg(F.min_by("component", F.struct("d", "component")).alias("c")).select("c").scalar()
    return comp.withColumn("kept", F.col("component") == best)


@query("g2_straddling_parcels", """
WITH RECURSIVE s AS (SELECT n_nationkey::BIGINT AS k, n_nationkey * 10.0::DOUBLE AS x, n_nationkey * 5.0::DOUBLE AS y,
  2.0 + (n_nationkey % 3) AS h FROM nation),
e AS (SELECT a.k AS a, b.k AS b FROM s a, s b WHERE a.k <> b.k AND pow(greatest(0, abs(a.x - b.x) - a.h - b.h), 2)
  + pow(greatest(0, abs(a.y - b.y) - a.h - b.h), 2) <= 16),
r AS (SELECT k AS n, k AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b),
g AS (SELECT n AS parcel, min(c) AS component FROM r GROUP BY 1),
dd AS (SELECT component, min(sqrt(pow(greatest(0, abs(x - 101.0) - h), 2) + pow(greatest(0, abs(y - 52.0) - h), 2)))
  AS dist FROM g JOIN s ON s.k = g.parcel GROUP BY 1)
SELECT parcel, component, parcel % 7 AS pin, component = best AS core, kept, kept AND component <> best AS detached FROM (
 SELECT *, component = best OR parcel % 7 IN (SELECT parcel % 7 FROM g WHERE component = best) AS kept FROM g,
 (SELECT component AS best FROM dd ORDER BY dist, component LIMIT 1))""")
def g2_b(spark, d):
    """Parts of a parcel number that lie away from the kept group are added to it again."""
    p = squares(spark, d, "parcel", "rings").withColumn("d", geo.ring_distance(101.0, 52.0, F.col("rings")))
    parts = g2(spark, d).join(p, "parcel").select("parcel", "component", (F.col("parcel") % 7).alias("pin"), F.col("kept").alias("core"), "d")
    return graph.nearest_group(parts, "component", "pin", "d").drop("d")


@query("g3_site_record_from_cluster", _COMP + """
SELECT component, count(*) AS members, max(id) AS id, max_by(c_nationkey, id)::BIGINT AS c_nationkey,
 (SELECT string_agg(p::VARCHAR, ',' ORDER BY p) FROM (SELECT DISTINCT pid AS p FROM comp c2 JOIN site s2 USING (id)
  WHERE c2.component = comp.component)) AS pids FROM comp JOIN site USING (id) GROUP BY component""")
def g3(spark, d):
    s = sites(spark, d).withColumn("pids", F.array("pid"))
    j = s.join(site_components(spark, d), "id")
    m = graph.merge_records(j, "component", "id", ["id"], ["c_nationkey"], ["pids"])
    return m.withColumn("pids", F.array_join(F.transform("pids", lambda v: v.cast("string")), ","))
