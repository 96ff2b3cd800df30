"""Sources and sinks, shown on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.places import nation_shapes, squares
from fieldbook.catalog.registry import query
from fieldbook.sources import delimited, markup, records, sinks, table, text_table


@query("s1_decorated_header_csv", """
SELECT l_orderkey::VARCHAR AS order_id, count(*) AS rows, sum(l_linenumber)::BIGINT AS lines,
 round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def s1(spark, d):
    names = ["2. ORDER NUMBER", "37. LINE", "65. ON-SITE RELEASE TOTAL"]
    path = sinks.scratch(spark, "decorated")
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").toDF(*names).write.option(
        "header", True).csv(path)
    r = delimited.read_decorated_csv(spark, path, names)
    return r.groupBy(F.col("2").alias("order_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("37").try_cast("long")).alias("lines"),
        F.round(F.sum(F.col("65").try_cast("double")), 2).alias("quantity"))


@query("s2_partition_coverage", """
SELECT year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE year(o_orderdate) NOT IN (1998) GROUP BY 1""")
def s2(spark, d):
    """Year x priority file family with one file missing: the year it belongs to is dropped whole."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("part"),
                                         "o_totalprice")
    path = sinks.scratch(spark, "family")
    o.where(~((F.col("year") == 1998) & (F.col("part") == "3-MEDIUM"))).write.partitionBy("year", "part").parquet(path)
    got = spark.read.parquet(path)
    cover = delimited.coverage(got, list(range(1995, 2002)), o.select("part"), "year", "part")
    return delimited.complete_years_only(got, cover, "year").groupBy("year").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s2_coverage_table", """
SELECT y::BIGINT AS year, p AS part, count(o_orderkey) FILTER (NOT (y = 1998 AND p = '3-MEDIUM')) > 0 AS present
FROM range(1995, 2004) t(y) CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)
LEFT JOIN orders ON year(o_orderdate) = y AND o_orderpriority = p GROUP BY 1, 2""")
def s2_cover(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("part"))
    have = o.where(~((F.col("year") == 1998) & (F.col("part") == "3-MEDIUM")))
    return delimited.coverage(have, list(range(1995, 2004)), o, "year", "part")


def _grid_rows(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey")
    return li.select(
        F.year("l_shipdate").alias("year"), F.lit(14).alias("grid_code"), (k % 50).cast("int").alias("x"),
        (F.col("l_suppkey") % 20).cast("int").alias("y"), F.col("l_linenumber").alias("release_no"),
        (k % 9).cast("string").alias("chemical_no"), F.col("l_suppkey").cast("string").alias("facility_no"),
        F.when(F.col("l_returnflag") == "A", 6).otherwise(1).alias("media"), F.col("l_quantity").alias("conc"),
        F.col("l_discount").alias("tox_conc"), F.lit(0.0).alias("score"), F.lit(0.0).alias("ct_conc"),
        F.lit(0.0).alias("nct_conc"), F.col("l_tax").alias("pop"))


@query("s3_grid_microdata_two_layouts", """
SELECT year(l_shipdate) AS year, l_partkey % 50 AS x, count(*) AS rows, round(sum(l_quantity), 2) AS conc
FROM lineitem GROUP BY 1, 2""")
def s3(spark, d):
    g = _grid_rows(spark, d)
    old, new, stored = (sinks.scratch(spark, n) for n in ("grid13", "grid14", "grid"))
    g.where("year = 1995").drop("year").write.option("compression", "gzip").csv(old)
    g.where("year > 1995").write.option("compression", "gzip").option("header", True).csv(new)
    both = delimited.read_grid_microdata(spark, old, 1995).unionByName(delimited.read_grid_microdata(spark, new))
    delimited.store_grid(both, stored)
    return spark.read.parquet(stored).groupBy("year", "x").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("conc"), 2).alias("conc"))


@query("s4_sheet_rows_with_spills", """
WITH s AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 IN (3, 4) AND o_orderkey > 3 THEN NULL ELSE o_orderkey END
 AS num, o_orderpriority AS txt FROM orders),
f AS (SELECT *, max(num) OVER (ORDER BY pos) AS record FROM s)
SELECT record, string_agg(txt, ' / ' ORDER BY pos) AS continued, count(*) AS fragments FROM f WHERE num IS NULL
GROUP BY record""")
def s4(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    spill = (k % 7).isin(3, 4) & (k > 3)
    sheet = o.select(k.alias("pos"), F.when(spill, "rest of the text").otherwise(k.cast("string")).alias("seq"),
                     F.col("o_orderpriority").alias("txt"))
    fixed = records.repair_spills(sheet, "seq", "pos", ["txt"])
    return records.join_fragments(fixed, "pos", ["txt"])


@query("s4_nested_reports", """
SELECT o_orderkey, count(l_orderkey) AS children, coalesce(round(sum(l_quantity), 2), 0) AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def s4_nest(spark, d):
    calls = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    mats = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    n = records.nest_sheets({"calls": calls, "materials": mats}, "o_orderkey")
    qty = F.aggregate(F.coalesce("materials", F.array()), F.lit(0.0), lambda a, m: a + m.l_quantity)
    return n.select("o_orderkey",
                    F.when(F.col("materials").isNull(), 0).otherwise(F.size("materials")).alias("children"),
                    F.round(qty, 2).alias("quantity"))


@query("s5_unpivot_inventory", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, pollutant, value FROM (
 SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_quantity FROM lineitem)
UNPIVOT (value FOR pollutant IN (l_discount, l_tax, l_quantity))""")
def s5(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")],
        "l_quantity")
    return delimited.unpivot_inventory(li, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax", "l_quantity"])


@query("s6_nested_json_levels", """
SELECT o_orderkey AS id, o_orderstatus AS status, l_partkey AS chemical_id, l_quantity AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def s6(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    kids = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(
        F.col("l_partkey").alias("chemical_id"), F.col("l_quantity").alias("quantity"))).alias("chemicals"))
    nested = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).join(kids, "id", "left")
    path = sinks.scratch(spark, "nested")
    nested.select("id", F.array(F.struct("status", "chemicals")).alias("processes")).write.json(path)
    back = records.read_json_records(spark, path, "id bigint, processes array<struct<status:string, "
                                     "chemicals:array<struct<chemical_id:bigint,quantity:double>>>>")
    return records.flatten_levels(back, ["id"], [("processes", ["status", "chemicals"]),
                                                 ("chemicals", ["chemical_id", "quantity"])])


@query("s7_geojson_polygons", """
SELECT n_nationkey::BIGINT AS n_nationkey, part::BIGINT AS part,
 round(CASE WHEN part = 0 THEN 4 * pow(2.0 + n_nationkey % 3, 2) ELSE 1.0 END, 6) AS area
FROM nation, (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR n_nationkey % 2 = 0""")
def s7(spark, d):
    sq = squares(spark, d, "n_nationkey", "rings")
    unit = F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)),
                           F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))))
    multi = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(
        F.lit("MultiPolygon").alias("type"), F.array(F.col("rings"), unit).alias("coordinates")).alias("geometry")))
    coll = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.struct(
        F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"))).alias("features")))
    js = sq.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, multi).otherwise(coll).alias("js"))
    from fieldbook.functions import geo
    return records.geojson_polygons(js, "js", ["n_nationkey"]).select(
        "n_nationkey", "part", F.round(geo.area(F.col("rings")), 6).alias("area"))


@query("s8_overlapping_pages", """
SELECT ts::DATE AS search, count(*) AS rows, count(*) + CASE WHEN day(ts::DATE) % 5 = 0 THEN 3 ELSE 0 END AS declared,
 count(*) + CASE WHEN day(ts::DATE) % 5 = 0 THEN 3 ELSE 0 END >= 345 AS capped,
 day(ts::DATE) % 5 <> 0 AND count(*) < 345 AS complete FROM events GROUP BY ts::DATE""")
def s8(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("search"), "event_id", "user_id", "event_type",
                                         F.floor(F.hour("ts") / 8).alias("page"))
    n = e.groupBy("search").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("search", (F.col("n") + F.when(F.dayofmonth("search") % 5 == 0, 3).otherwise(0)).alias("declared"))
    again = e.where("event_id % 10 = 0").withColumn("page", F.col("page") + 1)
    return records.merge_pages(e.unionByName(again).join(n, "search"), "search", "declared",
                               ["event_id", "user_id", "event_type"], 345)


@query("s9_visible_page_lines")
def s9(spark, d):
    """Visible text lines of every page (rows only: DuckDB has no HTML parser)."""
    return markup.page_lines(text_table(spark, d, "pages", "page_id"), ["page_id", "url"], "html")


@query("s11_csv_and_json_sinks", """
SELECT c_mktsegment, count(*) AS customers, string_agg(DISTINCT c_nationkey::VARCHAR, '; ' ORDER BY c_nationkey::VARCHAR)
 AS nations FROM customer GROUP BY 1""")
def s11(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))).alias("nations"))
    cpath, jpath = sinks.scratch(spark, "csv"), sinks.scratch(spark, "json")
    sinks.write_csv(g, cpath, ["c_mktsegment", "customers", "nations"])
    back = spark.read.schema("c_mktsegment string, customers bigint, nations string").option("header", True).csv(cpath)
    sinks.write_summary(back, jpath, ["c_mktsegment", "customers", "nations"])
    return spark.read.schema("c_mktsegment string, customers bigint, nations string").json(jpath)


@query("s12_geojson_sink", """
SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS polygons, 2::BIGINT AS rings, round(2 * pow(n_nationkey + 8.0, 2)
 - pow((n_nationkey + 8.0) / 2, 2), 6) AS area FROM nation""")
def s12(spark, d):
    from fieldbook.functions import geo
    path = sinks.scratch(spark, "geojson")
    # the hole is wound the other way round, as the sink expects
    shp = nation_shapes(spark, d).select("n_nationkey", F.transform("rings", lambda r, i: F.when(
        (geo.signed_area(r) < 0) == (i == 0), r).otherwise(F.reverse(r))).alias("rings"))
    sinks.write_geojson_lines(shp, "rings", ["n_nationkey"], path)
    js = spark.read.text(path).select(F.get_json_object("value", "$.properties.n_nationkey").cast("long")
                                      .alias("n_nationkey"), "value")
    p = records.geojson_polygons(js, "value", ["n_nationkey"])
    return p.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("polygons"), F.sum(F.size("rings")).alias("rings"),
                                        F.round(F.sum(geo.area(F.col("rings"))), 6).alias("area"))


@query("s12_cell_mask_to_multipolygon", """
WITH c AS (SELECT DISTINCT l_suppkey % 10 AS k, l_partkey % 50 AS x, l_suppkey % 20 AS y FROM lineitem),
r AS (SELECT k, y, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS run FROM c)
SELECT c.k, count(*) AS cells, any_value(n) AS strips FROM c
JOIN (SELECT k, count(DISTINCT (y, run)) AS n FROM r GROUP BY 1) USING (k) GROUP BY 1""")
def s12_mask(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), (F.col("l_partkey") % 50).alias("x"),
                                           (F.col("l_suppkey") % 20).alias("y"))
    return sinks.cells_to_multipolygon(c, "k", "x", "y", 810.0).select("k", "cells", F.size("polygons").alias("strips"))


@query("s13_plot_file_receptors", """
SELECT l_returnflag AS grp, count(*) AS receptors, round(sum(l_quantity), 2) AS conc FROM lineitem
WHERE l_linenumber % 2 = 0 GROUP BY 1""")
def s13(spark, d):
    li = table(spark, d, "lineitem")
    line = F.format_string("%12.3f %12.3f %12.5f %8.2f %8.2f %8.2f  %s  %s", F.col("l_partkey").cast("double"),
                           F.col("l_suppkey").cast("double"), F.col("l_quantity"), F.lit(0.0), F.lit(0.0), F.lit(0.0),
                           F.when(F.col("l_linenumber") % 2 == 0, "PERIOD").otherwise("1-HR"), F.col("l_returnflag"))
    path = sinks.scratch(spark, "plot")
    head = table(spark, d, "nation").select(F.concat(F.lit("* MODEL ( 1 ) "), F.col("n_name")).alias("value"))
    head.unionByName(li.select(line.alias("value"))).write.text(path)
    r = delimited.read_plot_file(spark, path)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("receptors"), F.round(F.sum("conc"), 2).alias("conc"))
