"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.derive import sql_coordinates, sql_haversine, with_coordinates
from fieldbook.catalog.places import customers, releases, suppliers
from fieldbook.catalog.registry import query
from fieldbook.functions import geo, keys, values
from fieldbook.operators import rollups
from fieldbook.plans.quantiles import exact_quantiles
from fieldbook.sources import table, text_table

_LB = "l_returnflag <> 'R' AND l_linestatus <> 'O'"


@query("a1_facility_years", f"""
SELECT l_suppkey AS facility, year(l_shipdate) AS year, round(coalesce(sum(l_quantity) FILTER ({_LB}), 0), 2) AS total_lb,
 round(coalesce(sum(l_quantity * 0.5) FILTER ({_LB} AND l_returnflag = 'A'), 0), 2) AS air_lb,
 round(coalesce(sum(l_quantity) FILTER ({_LB} AND l_discount > 0.05), 0), 2) AS flagged_lb,
 round(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'), 0), 2) AS total_g,
 count(DISTINCT l_partkey) FILTER ({_LB}) AS n_items, count(*) FILTER ({_LB}) AS rows_lb,
 count(*) FILTER (l_returnflag = 'R') AS short_forms, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R')
 AS short_form_items, count(*) FILTER ({_LB} AND l_quantity IN (5, 250, 750)) AS range_midpoint_rows
FROM lineitem GROUP BY 1, 2""")
def a1(spark, d):
    return rollups.facility_years(releases(spark, d), "facility", "year", "chemical", "onsite")


@query("a3_reconcile_totals", """
SELECT o_orderkey AS k, round(o_totalprice, 2) AS total, parts, CASE WHEN s IS NULL THEN 'no parts found'
 WHEN abs(s - o_totalprice) <= greatest(0.01, 1e-6 * abs(o_totalprice)) THEN 'match' WHEN s < o_totalprice THEN 'short'
 ELSE 'exceeds' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS parts
 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def a3(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    return rollups.reconcile(p, t, ["k"], "l_extendedprice", "total").select(
        "k", F.round("total", 2).alias("total"), "parts", "verdict")


@query("a4_merge_certifications", """
WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_tax, l_suppkey FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_suppkey + 1 FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT l_orderkey, l_linenumber, count(*) AS certifications, count(DISTINCT (l_quantity, l_tax)) = 1 AND count(*) > 1 AS
 duplicate, round(CASE WHEN count(DISTINCT (l_quantity, l_tax)) = 1 THEN max(l_quantity) ELSE sum(l_quantity) END, 4) AS
 l_quantity, round(CASE WHEN count(DISTINCT (l_quantity, l_tax)) = 1 THEN max(l_tax) ELSE sum(l_tax) END, 4) AS l_tax,
 string_agg(DISTINCT l_suppkey::VARCHAR, ' + ' ORDER BY l_suppkey::VARCHAR) AS names FROM x GROUP BY 1, 2""")
def a4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_suppkey")
    again = li.where("l_orderkey % 4 = 0").withColumn("l_suppkey", F.col("l_suppkey") + 1)
    m = rollups.merge_certifications(li.unionByName(again), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"],
                                     "l_suppkey")
    return m.withColumns({c: F.round(c, 4) for c in ("l_quantity", "l_tax")})


@query("a5_dedupe_and_bucket", """
WITH f AS (SELECT l_returnflag, l_suppkey, year(l_shipdate) AS year, l_partkey % 50 AS pol, arg_min((l_quantity,
 l_linestatus), (l_orderkey, l_linenumber, l_extendedprice)) AS r FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT l_suppkey, year, round(sum(r[1]) FILTER (r[2] <> 'O' AND pol < 10), 2) AS cap, round(sum(r[1]) FILTER (r[2] <> 'O'
 AND pol BETWEEN 10 AND 29), 2) AS hap, round(sum(r[1]) FILTER (r[2] <> 'O' AND pol > 29), 2) AS other,
 count(*) FILTER (r[2] = 'O') AS set_aside FROM f GROUP BY 1, 2""")
def a5(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", F.year("l_shipdate").alias("year"),
                                            (F.col("l_partkey") % 50).alias("pol"), "l_quantity", "l_linestatus",
                                            "l_orderkey", "l_linenumber", "l_extendedprice")
    b = F.when(F.col("pol") < 10, "cap").when(F.col("pol") < 30, "hap").otherwise("other")
    r = rollups.dedupe_and_bucket(li, ["l_returnflag", "l_suppkey", "year", "pol"],
                                  ["l_orderkey", "l_linenumber", "l_extendedprice"], ["l_suppkey", "year"], b,
                                  ["cap", "hap", "other"], "l_quantity", F.col("l_linestatus") != "O")
    return r.withColumns({c: F.round(c, 2) for c in ("cap", "hap", "other")})


@query("a6_null_careful_sum", """
WITH c AS (SELECT c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_nationkey = 3 OR (c_nationkey > 12 AND c_custkey % 4 = 0)
 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_nationkey, round(sum(v), 2) AS total, count(v) > 0 AND count(v) < count(*) AS partial, CASE WHEN count(v) = 0 THEN
 'unknown' WHEN count(v) < count(*) THEN 'floor' ELSE 'total' END AS status FROM c GROUP BY 1""")
def a6(spark, d):
    n = F.col("c_nationkey")
    c = table(spark, d, "customer").select(n, F.when((n == 3) | ((n > 12) & (F.col("c_custkey") % 4 == 0)), None)
                                           .otherwise(F.col("c_acctbal")).alias("v"))
    return rollups.null_careful_sum(c, ["c_nationkey"], "v").withColumn("total", F.round("total", 2))


@query("a7_fan_out_check", """
WITH a AS (SELECT l_orderkey AS k, l_quantity FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT count(*) AS rows_before, sum(coalesce(m, 0))::BIGINT AS rows_after, round(sum(l_quantity), 2) AS sum_before,
 round(sum(l_quantity * coalesce(m, 0)), 2) AS sum_after, max(coalesce(m, 0)) AS widest, max(m) > 1 AS fans_out
FROM a LEFT JOIN b USING (k)""")
def a7(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity", "l_returnflag")
    r = rollups.fan_out_check(li.where("l_returnflag = 'N'"), li.where("l_returnflag <> 'N'"), ["k"], "l_quantity")
    return r.withColumns({c: F.round(c, 2) for c in ("sum_before", "sum_after")})


@query("a8_tabulations", """
WITH t AS (SELECT unnest([{'dim': 'status', 'value': o_orderstatus}, {'dim': 'priority', 'value': o_orderpriority},
 {'dim': 'year', 'value': year(o_orderdate)::VARCHAR}, {'dim': 'customer', 'value': CASE WHEN o_custkey % 7 = 0 THEN
 '(blank)' ELSE o_custkey::VARCHAR END}], recursive := true) FROM orders),
n AS (SELECT dim, value, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS r FROM n)
SELECT dim, value, n FROM r WHERE dim <> 'customer' OR r <= 60""")
def a8(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("customer"))
    return rollups.tabulate(o, ["status", "priority", "year", "customer"], {"customer": 60})


@query("a8_materials_once_per_report", """
SELECT l_partkey % 20 AS value, count(DISTINCT l_orderkey) AS hits FROM lineitem GROUP BY 1""")
def a8_b(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.col("l_partkey") % 20).alias("m"))  # one report's materials
    return rollups.tally(li, "m")


_HURT = """c AS (SELECT l_linestatus, CASE WHEN l_partkey % 7 = 0 THEN 'several' WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 3 = 0
 THEN NULL ELSE ' ' || l_quantity::INT END AS injured, CASE l_suppkey % 4 WHEN 0 THEN '12 ' WHEN 1 THEN '3.5' WHEN 2 THEN '-0' END AS evacuated
 FROM lineitem)"""


@query("a8_casualty_totals", f"""WITH {_HURT}
SELECT l_linestatus, count(*) AS reports, coalesce(sum(CASE WHEN regexp_full_match(trim(injured), '[0-9]+') THEN trim(injured)::BIGINT END), 0)::BIGINT
 AS injured, count(*) FILTER (trim(injured) <> '') AS with_injured, count(*) FILTER (injured = 'several') AS unreadable_injured,
 (12 * count(*) FILTER (evacuated = '12 '))::BIGINT AS evacuated, count(evacuated) AS with_evacuated, count(*) FILTER (evacuated = '3.5') AS
 unreadable_evacuated FROM c GROUP BY 1""")
def a8_c(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey") % 4
    li = table(spark, d, "lineitem").select(
        "l_linestatus", F.when(p % 7 == 0, "several").when(p % 5 == 0, "").when(p % 3 == 0, None).otherwise(
            F.concat(F.lit(" "), F.round("l_quantity").cast("int").cast("string"))).alias("injured"),
        F.when(s == 0, "12 ").when(s == 1, "3.5").when(s == 2, "-0").alias("evacuated"))
    return rollups.tolerant_totals(li, ["l_linestatus"], ["injured", "evacuated"])


@query("a9_facility_totals_by_basis", f"""
WITH s AS (SELECT s_suppkey, {sql_coordinates('s_suppkey')} FROM supplier),
n AS (SELECT s_suppkey, {sql_haversine(31.0, -91.0, 'lat', 'lon')} AS dist FROM s)
SELECT l_suppkey AS facility, l_returnflag AS basis, count(*) AS rows, round(sum(l_quantity), 2) AS total,
 round(min(dist), 6) AS nearest FROM lineitem JOIN n ON l_suppkey = s_suppkey WHERE dist <= 100 GROUP BY 1, 2""")
def a9(spark, d):
    box = geo.degree_box(31.0, -91.0, 100.0)
    s = suppliers(spark, d).where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    s = s.select(F.col("s_suppkey").alias("facility"), geo.haversine(31.0, -91.0, "lat", "lon").alias("dist")).where(
        "dist <= 100")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("facility"), F.col("l_returnflag").alias("basis"),
                                            "l_quantity")
    return li.join(s, "facility").groupBy("facility", "basis").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("total"),
        F.round(F.min("dist"), 6).alias("nearest"))


@query("a10_distinct_sets", """
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus,
 string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1""")
def a10(spark, d):
    return rollups.distinct_sets(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


_WIND = """w AS (SELECT ts, user_id % 3 AS station, CASE WHEN k % 7 = 0 THEN NULL ELSE (value * 3.6) % 360 END AS drct,
 CASE WHEN k % 11 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE k END::DOUBLE AS sknt
 FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""


def wind_obs(spark, d):
    k = values.nested("props", "k").cast("int")
    return table(spark, d, "events").select(
        "ts", (F.col("user_id") % 3).alias("station"),
        F.when(k % 7 == 0, "M").otherwise((F.col("value") * 3.6 % 360).cast("string")).alias("drct"),
        F.when(k % 11 == 0, "M").when(k % 10 == 0, "0").otherwise(k.cast("string")).alias("sknt"))


@query("a11_hourly_vector_wind", f"""
WITH {_WIND}, h AS (SELECT station, date_trunc('hour', ts) AS hour, count(*) AS n, avg(CASE WHEN sknt = 0 THEN 0 ELSE
 sknt * sin(radians(drct)) END) AS u, avg(CASE WHEN sknt = 0 THEN 0 ELSE sknt * cos(radians(drct)) END) AS v FROM w
 WHERE sknt IS NOT NULL AND (sknt = 0 OR drct IS NOT NULL) GROUP BY 1, 2)
SELECT station, hour, n, round(sqrt(u * u + v * v), 6) AS speed, CASE WHEN abs(u) + abs(v) > 1e-9 THEN
 round((degrees(atan2(u, v)) + 360) % 360, 5) END AS from_deg FROM h""")
def a11(spark, d):
    h = rollups.hourly_wind(wind_obs(spark, d), ["station"], "ts", "drct", "sknt")
    return h.select("station", "hour", "n", F.round("speed", 6).alias("speed"),
                    F.when(F.col("speed") > 1e-9, F.round("from_deg", 5)).alias("from_deg"))


@query("a11_weighted_circular_mean", """
SELECT user_id, round((degrees(atan2(sum(k * sin(radians((value * 3.6) % 360))), sum(k * cos(radians((value * 3.6) % 360)))))
 + 360) % 360, 5) AS mean_deg FROM (SELECT *, (props->>'$.k')::DOUBLE AS k FROM events) GROUP BY 1""")
def a11_b(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("value") * 3.6 % 360).alias("a"),
                                         values.nested("props", "k").cast("double").alias("k"))
    return rollups.circular_mean(e, ["user_id"], "a", "k").select("user_id", F.round("mean_deg", 5).alias("mean_deg"))


@query("a12_percentiles_per_bin", """
SELECT b - 1 AS bin, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median,
 round(quantile_cont(v, 0.9), 6) AS p90 FROM (SELECT generate_subscripts(embedding, 1) AS b, unnest(embedding)::DOUBLE AS v
 FROM embeddings) GROUP BY 1""")
def a12(spark, d):
    e = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("bin", "v"))
    q = exact_quantiles(e, ["bin"], "v", [0.1, 0.5, 0.9], ["p10", "median", "p90"])
    return q.withColumns({c: F.round(c, 6) for c in ("p10", "median", "p90")})


@query("a13_peer_comparison", """
WITH v AS (SELECT l_suppkey AS site, l_returnflag || l_linestatus AS item, sum(l_quantity) AS value FROM lineitem
 GROUP BY 1, 2), s AS (SELECT s_suppkey AS site, s_nationkey, s_acctbal FROM supplier),
p AS (SELECT v.*, s_acctbal FROM v JOIN s USING (site) WHERE site <> 7 AND s_nationkey % 5 = 2)
SELECT t.item, round(t.value, 2) AS target, round(m, 4) AS median, n AS n_peers, round(t.value / m, 6) AS ratio,
 round((t.value / (SELECT s_acctbal FROM s WHERE site = 7)) / mi, 6) AS intensity_ratio
FROM v t LEFT JOIN (SELECT item, median(value) AS m, count(*) AS n FROM p GROUP BY 1) USING (item)
LEFT JOIN (SELECT item, median(value / s_acctbal) AS mi FROM p WHERE s_acctbal > 0 GROUP BY 1) USING (item)
WHERE t.site = 7""")
def a13(spark, d):
    v = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("site"), F.concat("l_returnflag", "l_linestatus").alias("item")).agg(
        F.sum("l_quantity").alias("value"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), "s_nationkey", "s_acctbal")
    r = rollups.peer_comparison(v, s.where("site = 7"), s.where("site <> 7 AND s_nationkey % 5 = 2"), "site", "item",
                                "value", "s_acctbal")
    return r.select("item", F.round("target", 2).alias("target"), F.round("median", 4).alias("median"), "n_peers",
                    F.round("ratio", 6).alias("ratio"), F.round("intensity_ratio", 6).alias("intensity_ratio"))


@query("a14_survey_peaks", """
WITH y AS (SELECT user_id AS colony, day(ts) // 7 AS year, event_type AS species, max(greatest(floor(value) - 20, 0)) AS nests
 FROM events GROUP BY 1, 2, 3)
SELECT colony, species, max(nests) FILTER (nests > 0) AS peak, arg_min(year, (-nests, year)) FILTER (nests > 0) AS peak_year,
 count(*) FILTER (nests > 0) AS active_years, count(*) AS surveyed_years, max(year) FILTER (nests > 0) AS latest_active
FROM y GROUP BY 1, 2""")
def a14(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("colony"), F.floor(F.dayofmonth("ts") / 7).alias("year"),
        F.col("event_type").alias("species"),
        F.greatest(F.floor("value").cast("double") - 20, F.lit(0.0)).alias("nests"))
    return rollups.survey_peaks(e, "colony", "year", "species", "nests")


@query("a15_count_and_max", """
SELECT l_partkey, count(*) AS processes, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def a15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("processes"),
                                                                F.max("l_quantity").alias("most"))


@query("a16_presence_tally", """
SELECT quality::BIGINT AS quality, count(*) AS tested, count(*) FILTER (toxic = 1) AS present, min(doc_id) FILTER (toxic = 1)
 AS first_positive FROM labels GROUP BY 1""")
def a16(spark, d):
    return rollups.presence_tally(table(spark, d, "labels"), ["quality"], F.col("toxic") == 1, "doc_id")


@query("a16_positives_listed", "SELECT doc_id, quality::BIGINT AS quality FROM labels WHERE toxic = 1")
def a16_b(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select("doc_id", "quality")


@query("a17_unit_compliance", """
SELECT o_custkey, year(o_orderdate) AS year, count(*) AS records, count(*) FILTER (NOT ok) AS violations FROM (SELECT *,
 coalesce(CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END, true) AS ok FROM orders) GROUP BY 1, 2
HAVING count(*) FILTER (NOT ok) > 0""")
def a17(spark, d):
    """A missing compliance flag counts as compliant."""
    flag = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    o = table(spark, d, "orders").withColumn("ok", F.coalesce(flag, F.lit(True)))
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("ok")).alias("violations")).where("violations > 0")


_INV = """i AS (SELECT l_suppkey AS ai, year(l_shipdate) AS year, 'P' || l_linenumber AS item, l_quantity AS v FROM lineitem
 WHERE NOT (l_linenumber = 3 AND year(l_shipdate) < 1998) AND NOT (year(l_shipdate) = 2001 AND l_suppkey % 4 = 0)
 AND (l_suppkey + l_linenumber + year(l_shipdate)) % 6 <> 0)"""


def inventory(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ai"), F.year("l_shipdate").alias("year"),
                                            F.concat(F.lit("P"), "l_linenumber").alias("item"),
                                            F.col("l_quantity").alias("v"), "l_linenumber")
    return li.where(~((F.col("l_linenumber") == 3) & (F.col("year") < 1998))
                    & ~((F.col("year") == 2001) & (F.col("ai") % 4 == 0))
                    & ((F.col("ai") + F.col("l_linenumber") + F.col("year")) % 6 != 0)).drop("l_linenumber")


@query("a19_status_grid", f"""
WITH {_INV}, f AS (SELECT DISTINCT ai, year FROM i), s AS (SELECT item, min(year) AS lo, max(year) AS hi FROM i GROUP BY 1),
v AS (SELECT ai, year, item, sum(v) AS v FROM i GROUP BY 1, 2, 3)
SELECT ai, year, item, round(v, 2) AS v, CASE WHEN v IS NOT NULL THEN 'reported' WHEN year BETWEEN lo AND hi THEN
 'not reported' ELSE 'not collected' END AS status FROM f CROSS JOIN s LEFT JOIN v USING (ai, year, item)""")
def a19(spark, d):
    return rollups.status_grid(inventory(spark, d), "ai", "item", "year", "v").withColumn("v", F.round("v", 2))


@query("a19_complete_year", f"""
WITH {_INV}, n AS (SELECT year, count(DISTINCT ai) AS facilities FROM i GROUP BY 1),
c AS (SELECT a.year, a.facilities, b.facilities IS NULL OR a.facilities >= 0.9 * b.facilities AS complete FROM n a
 LEFT JOIN n b ON b.year = a.year - 1)
SELECT *, (SELECT max(year) FILTER (complete) FROM c) AS complete_through FROM c""")
def a19_b(spark, d):
    return rollups.complete_through(inventory(spark, d), "ai", "year")


@query("a24_collapse_plants", """
WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (c_custkey % 311)::VARCHAR END AS reg,
 1995 + c_custkey % 8 AS last_year, c_name FROM customer),
k AS (SELECT *, CASE WHEN reg = '' THEN 'i' || id ELSE 'r' || reg END AS k FROM f)
SELECT arg_max(id, (last_year, id)) AS id, count(*) AS merged, max(last_year) AS last_year,
 arg_max(c_name, (last_year, id)) AS c_name FROM k GROUP BY k""")
def a24(spark, d):
    k = F.col("c_custkey")
    f = table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "").otherwise((k % 311).cast("string")).alias("reg"),
        (k % 8 + 1995).alias("last_year"), "c_name")
    return rollups.collapse_plants(f, "id", "reg", "last_year", ["c_name"])


_PLANTS = """f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (c_custkey % 311)::VARCHAR END AS reg, 1995 + c_custkey % 8 AS last_year FROM customer),
k AS (SELECT *, CASE WHEN id % 10 = 3 THEN id - 1 ELSE id END AS canon FROM f),
p AS (SELECT k.*, CASE WHEN c.reg <> '' THEN 'r' || c.reg ELSE 'i' || canon END AS k FROM k LEFT JOIN f c ON c.id = canon),
n AS (SELECT k, arg_max(id, (last_year, id)) AS plant FROM p GROUP BY k)"""


def plants(spark, d):
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    f = c.select(k.alias("id"), F.when(k % 5 == 0, "").otherwise((k % 311).cast("string")).alias("reg"), (k % 8 + 1995).alias("last_year"))
    return f, c.where(k % 10 == 3).select(k.alias("alias"), (k - 1).alias("canon"))


@query("a24_plant_years", f"""
WITH {_PLANTS}, y AS (SELECT k, o_custkey, year(o_orderdate) AS y FROM p JOIN orders ON o_custkey = id)
SELECT plant AS id, count(*) AS merged, max(last_year) AS last_year, (SELECT coalesce(string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR), '')
 FROM y WHERE y.k = p.k) AS years FROM p JOIN n USING (k) GROUP BY p.k, plant""")
def a24_years(spark, d):
    f, al = plants(spark, d)
    y = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y")).distinct().groupBy("id").agg(
        F.collect_list("y").alias("years"))
    got = rollups.collapse_plants(f.join(y, "id", "left"), "id", "reg", "last_year", [], al, "years")
    return got.withColumn("years", F.array_join("years", ","))


@query("a24_plant_members", f"WITH {_PLANTS} SELECT plant, id AS member FROM p JOIN n USING (k) WHERE id <> plant")
def a24_members(spark, d):
    f, al = plants(spark, d)
    return rollups.plant_members(f, "id", "reg", "last_year", al)


@query("a24_collapse_with_aliases", """
WITH f AS (SELECT c_custkey AS id, 1995 + c_custkey % 8 AS last_year, c_name,
 CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END AS canon FROM customer)
SELECT arg_max(id, (last_year, id)) AS id, count(*) AS merged, max(last_year) AS last_year,
 arg_max(c_name, (last_year, id)) AS c_name FROM f GROUP BY canon""")
def a24_b(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    f = c.select(k.alias("id"), F.lit("").alias("reg"), (k % 8 + 1995).alias("last_year"), "c_name")
    al = c.where(k % 10 == 3).select(k.alias("alias"), (k - 1).alias("canon"))
    return rollups.collapse_plants(f, "id", "reg", "last_year", ["c_name"], al)


@query("a26_filer_groups", """
WITH f AS (SELECT user_id % 40 AS g, CASE event_id % 3 WHEN 0 THEN 'The Riverkeepers ' WHEN 1 THEN 'Riverkeeper ' ELSE
 'Riverkeepers, Inc. ' END || (user_id % 40) AS who, CASE WHEN event_id % 997 = 0 THEN 'withdrawal' WHEN event_id % 50 = 0
 THEN 'motion' ELSE 'late motion' END AS kind, ts::DATE AS filed FROM events),
n AS (SELECT g, who, count(*) AS n, min(filed) AS f FROM f GROUP BY 1, 2)
SELECT 'riverkeeper ' || g AS key, (SELECT arg_min(who, (-n, f, who)) FROM n WHERE n.g = f.g) AS name,
 count(DISTINCT who) AS variants, min(filed) AS first, max(filed) AS last, count(*) AS filings, CASE WHEN
 bool_or(kind = 'withdrawal') THEN 'withdrew' WHEN bool_or(kind = 'motion') THEN 'motion' ELSE 'late motion' END AS status
FROM f GROUP BY g""")
def a26(spark, d):
    g = (F.col("user_id") % 40).cast("string")
    m = F.col("event_id") % 3
    who = F.concat(F.when(m == 0, "The Riverkeepers ").when(m == 1, "Riverkeeper ").otherwise("Riverkeepers, Inc. "), g)
    kind = (F.when(F.col("event_id") % 997 == 0, "withdrawal").when(F.col("event_id") % 50 == 0, "motion")
            .otherwise("late motion"))
    e = table(spark, d, "events").select(who.alias("who"), kind.alias("kind"), F.to_date("ts").alias("filed"))
    e = e.withColumn("n", F.unix_date("filed"))
    r = rollups.filer_groups(e, "who", "kind", "n", keys.fold_filer("who"))
    return r.withColumns({"first": F.date_from_unix_date(F.col("first").cast("int")),
                          "last": F.date_from_unix_date(F.col("last").cast("int"))})


@query("a27_promised_and_actual", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 100 END AS ex,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 17 END AS nw, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE
 o_custkey % 90 END AS cur FROM orders)
SELECT o_orderkey, ex + coalesce(nw, 0) AS promised_total, cur - (ex + coalesce(nw, 0)) AS delta FROM o""")
def a27(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(
        k, F.when(k % 3 == 0, None).otherwise(c % 100).alias("ex"), F.when(k % 4 == 0, None).otherwise(c % 17)
        .alias("nw"), F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(c % 90).alias("cur"))
    return rollups.promised_and_actual(o, "ex", "nw", "cur").select("o_orderkey", "promised_total", "delta")


@query("a28_reader_coverage", """
WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
r AS (SELECT doc_id, w, r, CASE r WHEN 'a' THEN length(w) > 1 ELSE doc_id % 5 = 0 OR length(w) > 3 END AS absent
 FROM l, (SELECT unnest(['a', 'b']) AS r))
SELECT doc_id, r AS reader, count(*) AS lines, count(*) FILTER (absent) AS absent, round(count(*) FILTER (absent) / count(*), 6)
 AS absent_rate FROM r GROUP BY 1, 2 HAVING count(*) >= 50 AND count(*) FILTER (absent) / count(*) >= 0.9""")
def a28(spark, d):
    w = text_table(spark, d, "documents", "doc_id").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    w = w.withColumn("reader", F.explode(F.array(F.lit("a"), F.lit("b"))))
    absent = F.when(F.col("reader") == "a", F.length("w") > 1).otherwise((F.col("doc_id") % 5 == 0)
                                                                       | (F.length("w") > 3))
    return rollups.reader_coverage(w, ["doc_id"], "reader", absent).withColumn("absent_rate", F.round("absent_rate", 6))


@query("a29_detections_per_overpass", """
SELECT event_type, count(*) AS detections, count(DISTINCT (ts::DATE, hour(ts))) AS overpasses, min(ts::DATE) AS first,
 max(ts::DATE) AS last, max(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, k)) AS peak
FROM (SELECT *, (props->>'$.k')::DOUBLE AS k FROM events) GROUP BY 1""")
def a29(spark, d):
    """Two sensors name the reading differently; the first one present is used."""
    power = F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value")), values.nested("props", "k").cast("double"))
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"),
                                         power.alias("power"))
    return rollups.detections(e, ["event_type"], "day", "hour", "power")


@query("a30_repeat_visitors", """
SELECT user_id, count(*) AS visits FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0 GROUP BY 1
HAVING count(*) >= 2""")
def a30(spark, d):
    e = table(spark, d, "events")
    return rollups.repeat_visitors(e.where("event_type = 'purchase'"), "user_id",
                                   e.where("user_id % 5 = 0").select("user_id"))


@query("a31_amount_by_status", """
SELECT o_orderstatus, count(*) AS records, round(sum(coalesce(o_totalprice, 0)), 2) AS mw FROM orders GROUP BY 1""")
def a31(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum("o_totalprice"), 2).alias("mw"))


@query("a32_top_loads_with_quality", """
WITH g AS (SELECT l_suppkey % 10 AS huc, l_partkey % 40 AS pol, sum(CASE WHEN l_partkey % 40 < 3 THEN 0 WHEN l_partkey % 40 = 5
 THEN NULL ELSE l_quantity END) AS total, count(CASE WHEN l_partkey % 40 = 5 THEN NULL ELSE 1 END) AS n FROM lineitem
 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY huc ORDER BY total DESC NULLS LAST, pol) AS rank FROM g)
SELECT huc, pol, round(total, 2) AS total, n, rank, CASE WHEN n = 0 THEN 'not reported' WHEN total = 0 THEN
 'no calculated load' ELSE 'calculated' END AS quality FROM r WHERE rank <= 38""")
def a32(spark, d):
    p = F.col("l_partkey") % 40
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("huc"), p.alias("pol"),
                                            F.when(p < 3, 0.0).when(p == 5, None).otherwise(F.col("l_quantity"))
                                            .alias("v"))
    return rollups.ranked_totals(li, ["huc"], "pol", "v", 38).withColumn("total", F.round("total", 2))


@query("a32_exceedances_by_year", """
SELECT l_suppkey, year(l_shipdate) AS year, count(*) FILTER (l_quantity > 45) AS exceedances,
 round(sum(l_quantity - 45) FILTER (l_quantity > 45), 2) AS over_limit FROM lineitem GROUP BY 1, 2""")
def a32_b(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    q = F.col("l_quantity")
    return rollups.exceedances(li, ["l_suppkey"], "year", q > 45, q - 45).withColumn(
        "over_limit", F.round("over_limit", 2))


@query("a33_hazard_profile", """
WITH h AS (SELECT p_partkey, unnest([{'hazard': 'flood', 'loss': p_retailprice, 'rating': CASE p_size % 3 WHEN 0 THEN 'Very High'
 WHEN 1 THEN 'Relatively Low' ELSE 'No Rating' END}, {'hazard': 'wind', 'loss': p_size * 30.0::DOUBLE, 'rating': 'Relatively Moderate'},
 {'hazard': 'hail', 'loss': CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 50.0::DOUBLE END, 'rating': CASE WHEN p_partkey % 4 = 0 THEN
 'Very High' ELSE 'Very Low' END}], recursive := true) FROM part),
o AS (SELECT *, list_position(['Very High', 'Relatively High', 'Relatively Moderate', 'Relatively Low', 'Very Low'], rating) AS o
 FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY coalesce(loss, 0) DESC, hazard) AS rank,
 min(o) OVER (PARTITION BY p_partkey) AS best FROM o)
SELECT p_partkey, hazard, loss, rating, rank, coalesce(o = best, false) AS best_rated FROM r WHERE rank <= 2""")
def a33(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    p = table(spark, d, "part").select(
        k, F.col("p_retailprice").alias("flood"), (F.col("p_size") * 30.0).alias("wind"),
        F.when(k % 2 == 0, None).otherwise(50.0).alias("hail"),
        F.when(s == 0, "Very High").when(s == 1, "Relatively Low").otherwise("No Rating").alias("flood_r"),
        F.lit("Relatively Moderate").alias("wind_r"), F.when(k % 4 == 0, "Very High").otherwise("Very Low")
        .alias("hail_r"))
    return rollups.hazard_profile(p, "p_partkey", ["flood", "wind", "hail"], ["flood_r", "wind_r", "hail_r"],
                                  ["Very High", "Relatively High", "Relatively Moderate", "Relatively Low",
                                   "Very Low"], 2)


@query("a34_release_points", f"""
WITH s AS (SELECT s_suppkey, {sql_coordinates('s_suppkey')} FROM supplier)
SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, count(DISTINCT l_partkey % 30) AS sources,
 count(DISTINCT l_returnflag) AS items, round_even({sql_haversine('any_value(lat)', 'any_value(lon)', 31.0, -91.0, 6371000.0)}, 0)
 AS to_receptor_m FROM lineitem JOIN s ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def a34(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_partkey") % 30).alias("src"),
                                            "l_returnflag")
    li = with_coordinates(li, "l_suppkey")
    return rollups.release_points(li, ["l_suppkey", "l_linenumber"], "src", "l_returnflag", "lat", "lon",
                                  (31.0, -91.0)).select("l_suppkey", "l_linenumber", "sources", "items",
                                                        "to_receptor_m")


@query("a34_release_point_lists", """
SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, list_aggregate(list_sort(list_distinct(list(l_partkey % 30))), 'string_agg', ',') AS sources,
 list_aggregate(list_sort(list_distinct(list(l_returnflag))), 'string_agg', ',') AS items FROM lineitem GROUP BY 1, 2""")
def a34_lists(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_partkey") % 30).alias("src"), "l_returnflag")
    g = rollups.release_points(with_coordinates(li, "l_suppkey"), ["l_suppkey", "l_linenumber"], "src", "l_returnflag", "lat", "lon", (31.0, -91.0))
    return g.select("l_suppkey", "l_linenumber", F.array_join("sources_list", ",").alias("sources"), F.array_join("items_list", ",").alias("items"))


@query("a35_weighted_indicator", """
WITH c AS (SELECT c_mktsegment, c_custkey % 50 AS w, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_mktsegment, round(sum(coalesce(v, 0) * w) / sum(w), 6) AS missing_as_zero, round(sum(v * w) / sum(w) FILTER
 (v IS NOT NULL), 6) AS known_only, count(*) FILTER (v IS NULL) AS missing FROM c GROUP BY 1""")
def a35(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_mktsegment", (k % 50).alias("w"),
                                           F.when(k % 6 == 0, None).otherwise(F.col("c_acctbal")).alias("v"))
    r = rollups.weighted_indicator(c, ["c_mktsegment"], "v", "w")
    return r.withColumns({c: F.round(c, 6) for c in ("missing_as_zero", "known_only")})


@query("a36_area_by_class", """
WITH f AS (SELECT p_size % 60 AS place, p_type, p_retailprice FROM part WHERE p_size % 60 BETWEEN 5 AND 40)
SELECT n::BIGINT AS place, p_type, count(p_type) AS cnt, round(sum(p_retailprice), 2) AS area, CASE WHEN p_type IS NOT NULL THEN
 'found' WHEN n < 45 THEN 'none_found' ELSE 'out_of_coverage' END AS status
FROM (SELECT DISTINCT p_size AS n FROM part) LEFT JOIN f ON place = n GROUP BY 1, 2, n""")
def a36(spark, d):
    p = table(spark, d, "part")
    places = p.select(F.col("p_size").alias("place")).distinct()
    found = p.where(F.col("p_size").between(5, 40)).select(F.col("p_size").alias("place"), "p_type", "p_retailprice")
    r = rollups.class_areas(found, places.where("place < 45"), places, "place", "p_type", "p_retailprice")
    return r.select("place", "p_type", F.coalesce("polygons", F.lit(0)).alias("cnt"),
                    F.round("area", 2).alias("area"), "status")


@query("a37_stated_and_computed_area", """
WITH l AS (SELECT l_orderkey AS g, l_linenumber AS p, sum(l_extendedprice) AS st, sum(l_quantity) AS cp FROM lineitem GROUP BY 1, 2)
SELECT g AS agreement, round(sum(st), 2) AS stated, round(sum(cp) FILTER (p <> 2), 2) AS computed, count(*) FILTER (p <> 2) AS
 mapped_parts, count(*) FILTER (p = 2) AS missing_parts, round(sum(st) - coalesce(sum(st) FILTER (p = 2), 0), 2) AS
 stated_mapped_parts FROM l GROUP BY 1""")
def a37(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("agreement"), F.col("l_linenumber").alias("p")).agg(
        F.sum("l_extendedprice").alias("st"), F.sum("l_quantity").alias("cp"))
    r = rollups.stated_and_computed(li.where("p <> 2"), li, "agreement", "p", "cp", "st")
    return r.withColumns({c: F.round(c, 2) for c in ("stated", "computed", "stated_mapped_parts")})


@query("a37_share_per_parish", """
WITH w AS (SELECT l_orderkey AS agreement, l_suppkey % 8 AS parish, sum(l_quantity::DOUBLE) AS w FROM lineitem GROUP BY 1, 2)
SELECT agreement, parish, round_even(100.0 * w / sum(w) OVER (PARTITION BY agreement), 0)::BIGINT AS percent,
 row_number() OVER (PARTITION BY agreement ORDER BY w DESC, parish) AS place FROM w""")
def a37_b(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("agreement"), (F.col("l_suppkey") % 8).alias("parish"), "l_quantity")
    return rollups.area_shares(li, ["agreement"], "parish", "l_quantity")


@query("a38_sections_by_reference", """
WITH i AS (SELECT user_id, event_id % 4 AS ref, CASE event_id % 4 WHEN 0 THEN 'Harmonised list' ELSE 'Maker ' || event_id % 4 END
 AS src, event_type, props FROM events), g AS (SELECT user_id, ref, src, min(props) FILTER (event_type = 'click') AS signal,
 count(*) FILTER (event_type = 'view') AS statements, min(props) FILTER (event_type = 'error') AS note FROM i GROUP BY 1, 2, 3
 HAVING count(*) FILTER (event_type = 'view') > 0)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY NOT starts_with(src, 'Harmonised'), src, ref) AS rank FROM g""")
def a38(spark, d):
    r = F.col("event_id") % 4
    nm = F.when(F.col("event_type") == "click", "Signal").when(F.col("event_type") == "view", "Statements").when(
        F.col("event_type") == "error", "Note")
    i = table(spark, d, "events").select(
        "user_id", r.alias("ref"), F.when(r == 0, "Harmonised list").otherwise(F.concat(F.lit("Maker "), r)).alias("src"),
        nm.alias("name"), "props")
    return rollups.by_reference(i, ["user_id"], "ref", "src", "name", "props", "Harmonised")


@query("a39_hits_per_docket", """
SELECT v AS value, count(*) AS hits FROM (SELECT DISTINCT doc_id, unnest([source, lang, source]) AS v FROM documents) GROUP BY 1""")
def a39(spark, d):
    return rollups.tally(text_table(spark, d, "documents", "doc_id").select(F.array("source", "lang", "source").alias("l")), "l")
