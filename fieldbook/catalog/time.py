"""Windows, intervals, as-of joins, exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.registry import query
from fieldbook.functions import dates, units, values
from fieldbook.operators import exposure, lookup, ranking, temporal
from fieldbook.sources import table, text_table


def orders(spark, d):
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def events(spark, d):
    return table(spark, d, "events").withColumn("k", values.nested("props", "k").cast("int"))




@query("w1_latest_per_key", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate)::DATE AS day,
 arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1""")
def w1(spark, d):
    o = orders(spark, d).select("o_custkey", "o_orderkey", "day", "o_orderstatus")
    return ranking.latest(o, ["o_custkey"], ["day", "o_orderkey"])


@query("w2_newest_submission_per_day", """
WITH e AS (SELECT user_id, ts::DATE AS day, k % 4 AS sub, event_id FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))
SELECT user_id, day, sub, event_id FROM e QUALIFY sub = max(sub) OVER (PARTITION BY user_id, day)""")
def w2(spark, d):
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), (F.col("k") % 4).alias("sub"), "event_id")
    return ranking.newest_submission(e, ["user_id", "day"], ["sub"])


_COHORT = """c AS (SELECT s_nationkey % 6 AS code, s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS v
 FROM supplier)"""


def cohort(spark, d):
    return table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 6).alias("code"), "s_suppkey",
        F.when(F.col("s_suppkey") % 9 == 0, None).otherwise(F.col("s_acctbal")).alias("v"))


@query("w3_rank_in_cohort", f"""
WITH {_COHORT}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY v DESC, s_suppkey) AS rank FROM c WHERE v IS NOT NULL)
SELECT code::BIGINT AS code, s_suppkey, v, rank FROM r WHERE rank <= 5""")
def w3(spark, d):
    return ranking.cohort_rank(cohort(spark, d), ["code"], "s_suppkey", "v", 5)[0]


@query("w3_upper_median_and_non_reporters", f"""
WITH {_COHORT}, m AS (SELECT code, list(v ORDER BY v) FILTER (v IS NOT NULL) AS l, count(v) AS reporting,
 count(*) FILTER (v IS NULL) AS not_reporting FROM c GROUP BY 1)
SELECT code::BIGINT AS code, reporting, not_reporting, l[len(l) // 2 + 1] AS median FROM m""")
def w3_b(spark, d):
    return ranking.cohort_rank(cohort(spark, d), ["code"], "s_suppkey", "v", 5)[1]


@query("w4_year_on_year_jump", """
WITH y AS (SELECT l_partkey, year(l_shipdate) AS year, sum(l_quantity * 10) AS v FROM lineitem GROUP BY 1, 2),
l AS (SELECT max(year) AS m FROM y)
SELECT a.l_partkey, a.year, round(a.v, 2) AS latest, round(coalesce(b.v, 0), 2) AS prior FROM y a LEFT JOIN y b
 ON b.l_partkey = a.l_partkey AND b.year = a.year - 1 WHERE a.year = (SELECT m FROM l) AND a.v >= 1000
 AND a.v >= 3 * greatest(1, coalesce(b.v, 0))""")
def w4(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"),
                                            (F.col("l_quantity") * 10).alias("v"))
    return ranking.jumps(li, ["l_partkey"], "year", "v").select(
        "l_partkey", "year", F.round("latest", 2).alias("latest"), F.round("prior", 2).alias("prior"))


@query("w5_top_items_of_latest_year", """
WITH g AS (SELECT l_suppkey, l_partkey % 100 AS item, year(l_shipdate) AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, max(y) OVER (PARTITION BY l_suppkey) AS last FROM g),
p AS (SELECT l_suppkey, item, sum(v) FILTER (y = last) AS latest, sum(v) AS period FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY latest DESC, item) AS rank FROM p WHERE latest > 0)
SELECT l_suppkey, item, round(latest, 2) AS latest, round(period, 2) AS period, rank FROM r WHERE rank <= 5""")
def w5(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("item"),
                                            F.year("l_shipdate").alias("y"), "l_quantity")
    r = ranking.top_of_latest(li, ["l_suppkey"], "item", "y", "l_quantity", 5)
    return r.select("l_suppkey", "item", F.round("latest", 2).alias("latest"), F.round("period", 2).alias("period"),
                    "rank")


@query("w6_on_off_transitions", """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 7 = 0 THEN 0.5 ELSE 1.0 END AS op
 FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
p AS (SELECT *, lag(op > 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e)
SELECT user_id, event_id, CASE WHEN prev IS NULL OR prev = (op > 0) THEN NULL WHEN op > 0 THEN 'START-UP' ELSE 'SHUTDOWN' END
 AS event, op > 0 AND op < 1 AS partial FROM p""")
def w6(spark, d):
    k = F.col("k")
    e = events(spark, d).select("user_id", "ts", "event_id", F.when(k % 3 == 0, 0.0).when(k % 7 == 0, 0.5)
                                .otherwise(1.0).alias("op"))
    return temporal.transitions(e, ["user_id"], ["ts", "event_id"], "op").select(
        "user_id", "event_id", "event", "partial")


_SPAN = """s AS (SELECT o_custkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 200)::INT + 1)::DATE AS e FROM orders)"""


def spans(spark, d):
    return orders(spark, d).select("o_custkey", F.col("day").alias("s"), F.date_add(
        "day", (F.col("o_orderkey") % 200 + 1).cast("int")).alias("e"), "o_orderkey", "o_orderstatus")


@query("w7_merge_intervals", f"""
WITH {_SPAN}, g AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1
 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER
 (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, island""")
def w7(spark, d):
    return temporal.merge_intervals(spans(spark, d).select("o_custkey", "s", "e"), ["o_custkey"], "s", "e")


@query("w8_window_fully_covered", """
WITH s AS (SELECT o_custkey, o_orderdate::DATE AS b, (o_orderdate::DATE + (o_orderkey % 200)::INT)::DATE AS e FROM orders
 WHERE o_orderstatus <> 'O'), w AS (SELECT o_custkey, o_orderdate::DATE AS b, (o_orderdate::DATE + 40)::DATE AS e, o_orderkey
 FROM orders WHERE o_orderstatus = 'O'),
x AS (SELECT DISTINCT o_custkey, d::DATE AS d FROM (SELECT o_custkey, unnest(generate_series(b, e, INTERVAL 1 DAY)) AS d FROM s)),
n AS (SELECT w.o_orderkey, count(x.d) AS days FROM w LEFT JOIN x ON x.o_custkey = w.o_custkey AND x.d BETWEEN w.b AND w.e GROUP BY 1)
SELECT o_orderkey, days = 41 AS covered FROM n""")
def w8(spark, d):
    o = orders(spark, d)
    done = o.where("o_orderstatus <> 'O'").select("o_custkey", F.col("day").alias("b"), F.date_add(
        "day", (F.col("o_orderkey") % 200).cast("int")).alias("e"))
    win = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.col("day").alias("wb"),
                                                F.date_add("day", 40).alias("we"))
    return temporal.tiled(win, done, ["o_custkey"], ("wb", "we"), ("b", "e")).select("o_orderkey", "covered")


@query("w9_year_runs_as_text", """
WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders),
r AS (SELECT *, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS r FROM y),
g AS (SELECT o_custkey, min(y) AS a, max(y) AS b FROM r GROUP BY o_custkey, r)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM g GROUP BY 1""")
def w9(spark, d):
    return temporal.year_runs(orders(spark, d).select("o_custkey", F.year("day").alias("y")), ["o_custkey"], "y")


@query("w10_value_drift", """
WITH y AS (SELECT DISTINCT o_custkey, o_orderstatus, year(o_orderdate) AS y FROM orders),
r AS (SELECT *, y - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY y) AS r FROM y),
g AS (SELECT o_custkey, o_orderstatus, min(y) AS a, max(y) AS b FROM r GROUP BY o_custkey, o_orderstatus, r)
SELECT o_custkey, o_orderstatus, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS years
FROM g GROUP BY 1, 2""")
def w10(spark, d):
    o = orders(spark, d).withColumn("y", F.year("day"))
    return temporal.value_drift(o, ["o_custkey"], "o_orderstatus", "y")


@query("w11_consecutive_duplicates_dropped", """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
 FROM events) WHERE p IS NULL OR p <> event_type""")
def w11(spark, d):
    return temporal.drop_repeats(table(spark, d, "events"), ["user_id"], ["ts", "event_id"],
                                 "event_type").select("user_id", "event_id", "event_type")


@query("w13_sibling_median_outliers", """
WITH v AS (SELECT p_partkey, p_brand, p_retailprice * CASE WHEN p_partkey % 97 = 0 THEN 20 WHEN p_partkey % 89 = 0 THEN 0.01 ELSE 1
 END AS v FROM part), m AS (SELECT p_brand, median(v) AS m, count(*) AS siblings FROM v WHERE v > 0 GROUP BY 1)
SELECT p_partkey, p_brand, round(v, 4) AS v, round(m, 4) AS sibling_median, siblings FROM v JOIN m USING (p_brand)
WHERE siblings >= 3 AND (v > m * 10 OR v < m * 0.1)""")
def w13(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, "p_brand", (F.col("p_retailprice") * F.when(k % 97 == 0, 20.0).when(
        k % 89 == 0, 0.01).otherwise(1.0)).alias("v"))
    r = ranking.sibling_outliers(p, ["p_brand"], "v")
    return r.select("p_partkey", "p_brand", F.round("v", 4).alias("v"), F.round("sibling_median", 4)
                    .alias("sibling_median"), "siblings")


@query("w13_identifier_length_majority", """
WITH i AS (SELECT o_custkey % 50 AS kind, CASE WHEN o_orderkey % 211 = 0 THEN '77-' || (10000 + o_orderkey % 9) ELSE '777-' ||
 (10000 + o_orderkey % 90) END AS v FROM orders), l AS (SELECT *, length(regexp_replace(v, '\\D', '', 'g')) AS n FROM i),
m AS (SELECT kind, arg_min(n, (-c, n)) AS majority, sum(c)::BIGINT AS seen FROM (SELECT kind, n, count(*) AS c FROM l GROUP BY 1, 2)
 GROUP BY 1)
SELECT kind, v, n AS digits, majority, seen FROM l JOIN m USING (kind) WHERE seen >= 3 AND n <> majority""")
def w13_b(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 211 == 0, F.concat(F.lit("77-"), k % 9 + 10000)).otherwise(F.concat(F.lit("777-"), k % 90 + 10000))
    o = orders(spark, d).select((F.col("o_custkey") % 50).alias("kind"), v.alias("v"))
    return ranking.odd_lengths(o, "kind", "v")


@query("w14_anchored_interpolation", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER
 (PARTITION BY user_id) AS n, CASE WHEN k % 3 = 0 THEN value END AS v FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
a AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN
 UNBOUNDED PRECEDING AND CURRENT ROW) AS lp, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN
 UNBOUNDED PRECEDING AND CURRENT ROW) AS lv, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (PARTITION BY user_id
 ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hp, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hv FROM e)
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE coalesce(lv, hv - 1) + (coalesce(hv, lv + 1) - coalesce(lv, hv - 1))
 * (p - coalesce(lp, 0)) / (coalesce(hp, n + 1) - coalesce(lp, 0)) END, 6) AS filled FROM a""")
def w14(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ts", F.when(F.col("k") % 3 == 0, F.col("value")).alias("v"))
    return temporal.fill_between(e, ["user_id"], ["ts", "event_id"], "v").select(
        "user_id", "event_id", F.round("filled", 6).alias("filled"))


@query("w15_scope_widening_shortlist", """
WITH s AS (SELECT s_suppkey, s_nationkey, s_nationkey % 5 AS region, CASE WHEN s_suppkey % 4 > 0 AND s_acctbal > 0 THEN s_acctbal END AS size FROM supplier),
p AS (SELECT t.s_suppkey AS target, s.s_suppkey AS peer, CASE WHEN s.s_nationkey = t.s_nationkey THEN 0 WHEN s.region = t.region THEN 1
 ELSE 2 END AS sc, s.size IS NOT NULL AS ok, abs(ln(s.size / t.size)) AS lr FROM s t JOIN s ON s.s_suppkey <> t.s_suppkey WHERE t.size IS NOT NULL),
c AS (SELECT target, CASE WHEN count(*) FILTER (ok AND sc = 0) >= 4 THEN 0 WHEN count(*) FILTER (ok AND sc <= 1) >= 4 THEN 1 ELSE 2 END
 AS pick FROM p GROUP BY 1), r AS (SELECT p.*, pick, row_number() OVER (PARTITION BY target ORDER BY NOT ok, lr, peer) AS place FROM p JOIN c
 USING (target) WHERE sc <= pick)
SELECT target, peer, ['state', 'region', 'national'][pick + 1] AS chosen_scope, place, ok AS size_known FROM r WHERE place <= 6""")
def w15(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 5).alias("region"), F.lit(1).alias("all"),
                                           F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("size"))
    return ranking.nearest_in_scope(s, "s_suppkey", "size", {"state": "s_nationkey", "region": "region", "national": "all"}, 4, 6)


@query("w16_at_most_k_per_day", """
SELECT day, event_id, value, place FROM (SELECT ts::DATE AS day, event_id, value, row_number() OVER (PARTITION BY ts::DATE
 ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 2""")
def w16(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    return ranking.at_most_per(e, ["day"], [F.col("value").desc(), F.col("event_id")], 2)


@query("w17_evenly_spread_sample", """
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER
 (PARTITION BY user_id) AS n FROM events), j AS (SELECT unnest(range(7)) AS j)
SELECT DISTINCT user_id, event_id FROM p, j WHERE n <= 7 OR i = floor(j * (n / 7.0))""")
def w17(spark, d):
    return ranking.spread_sample(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 7).select(
        "user_id", "event_id")


@query("w17_spread_days", """
WITH c AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)
SELECT DISTINCT o_custkey, (a + round_even(i * (b - a) / 5.0, 0)::INT)::DATE AS day FROM c, range(6) t(i) WHERE b - a + 1 > 6
UNION SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE FROM c WHERE b - a + 1 <= 6""")
def w17_b(spark, d):
    c = orders(spark, d).groupBy("o_custkey").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return c.select("o_custkey", F.explode(ranking.spread_days(F.col("a"), F.col("b"), 6)).alias("day"))


@query("w19_change_flags", """
WITH e AS (SELECT user_id, event_id, event_type AS sensor, k % 2 AS rate, lag(event_type) OVER w AS ps, lag(k % 2) OVER w AS pr,
 lag(event_id) OVER w AS pe FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN pe IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ps <> sensor THEN 'sensor' END, CASE WHEN pr <> rate
 THEN 'rate' END) END AS changed FROM e""")
def w19(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ts", F.col("event_type").alias("sensor"),
                                (F.col("k") % 2).alias("rate"))
    return temporal.change_flags(e, ["user_id"], ["ts", "event_id"], ["sensor", "rate"]).select(
        "user_id", "event_id", "changed")


@query("w20_height_interpolation", """
WITH l AS (SELECT DISTINCT c_nationkey::BIGINT AS prof, (c_custkey * 37 % 5000)::DOUBLE AS z, c_custkey % 17 - 8.0 AS u FROM customer),
 lv AS (SELECT prof, z, min(u)::DOUBLE AS u FROM l GROUP BY 1, 2),
w AS (SELECT DISTINCT c_nationkey::BIGINT AS prof, h::DOUBLE AS h FROM customer, unnest([250, 1000, 2222, 4800]) t(h)),
b AS (SELECT w.prof, h, (SELECT max(z) FROM lv WHERE lv.prof = w.prof AND z <= h) AS z0, (SELECT min(z) FROM lv WHERE lv.prof = w.prof
 AND z >= h) AS z1 FROM w)
SELECT b.prof, h, CASE WHEN z0 IS NULL OR z1 IS NULL OR (z1 - z0 > 300 AND h NOT IN (z0, z1)) THEN NULL WHEN z1 = z0 THEN round(x.u, 6)
 ELSE round(x.u + (h - z0) / (z1 - z0) * (y.u - x.u), 6) END AS u FROM b LEFT JOIN lv x ON x.prof = b.prof AND x.z = z0
 LEFT JOIN lv y ON y.prof = b.prof AND y.z = z1""")
def w20(spark, d):
    c = table(spark, d, "customer")
    lv = c.groupBy(F.col("c_nationkey").cast("long").alias("prof"), (
        F.col("c_custkey") * 37 % 5000).cast("double").alias("z")).agg(
        F.min(F.col("c_custkey") % 17 - 8.0).alias("u"))
    ask = c.select(F.col("c_nationkey").cast("long").alias("prof")).distinct().withColumn("h", F.explode(F.array(
        *[F.lit(float(h)) for h in (250, 1000, 2222, 4800)])))
    return temporal.level_interpolation(ask, lv, ["prof"], "h", "z", ["u"], 300.0).withColumn("u", F.round("u", 6))


@query("w20_refraction", """
WITH l AS (SELECT c_nationkey::BIGINT AS prof, (c_custkey * 37 % 5000)::DOUBLE AS z, min(331.3 * sqrt(1 + (c_custkey % 30 - 5.0) / 273.15)
 + c_custkey % 17 - 8.0) AS c FROM customer GROUP BY 1, 2),
g AS (SELECT prof, min(z) AS low_z, arg_min(c, z) AS s, arg_min(z, (abs(z - 200), z)) FILTER (z > 0) AS top_z,
 arg_min(c, (abs(z - 200), z)) FILTER (z > 0) AS t FROM l GROUP BY 1)
SELECT prof, low_z, top_z, round(t - s, 6) AS delta, CASE WHEN t - s > 0 THEN 'downward' WHEN t IS NOT NULL THEN 'upward' END AS refraction FROM g""")
def w20_b(spark, d):
    k = F.col("c_custkey")
    lv = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("prof"), (k * 37 % 5000).cast("double").alias("z")).agg(
        F.min(units.sound_speed(k % 30 - 5.0, k % 17 - 8.0)).alias("c"))
    return temporal.refraction(lv, ["prof"], "z", "c", 200.0).withColumn("delta", F.round("delta", 6))


@query("w21_documents_of_docket", """
SELECT docket, doc_id, source, row_number() OVER (PARTITION BY docket ORDER BY doc_id, source) AS place
FROM (SELECT DISTINCT doc_id % 300 AS docket, doc_id, source FROM documents)""")
def w21_b(spark, d):
    r = text_table(spark, d, "documents", "doc_id").select((F.col("doc_id") % 300).alias("docket"), "doc_id", "source")
    return lookup.docket_documents(r, "docket", "doc_id", "source")


@query("w21_one_row_per_docket", """
WITH r AS (SELECT doc_id % 300 AS docket, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 1990 + doc_id % 30 END AS decided, lang || doc_id % 7
 AS caption, source, doc_id FROM documents)
SELECT docket, arg_min(decided, doc_id) FILTER (decided IS NOT NULL) AS date, arg_min(caption, (CASE WHEN source = 'src3' THEN 0 ELSE 1
 END, doc_id)) AS caption, count(*) AS records, count(DISTINCT doc_id) AS documents FROM r GROUP BY 1""")
def w21(spark, d):
    k = F.col("doc_id")
    r = text_table(spark, d, "documents", "doc_id").select(
        (k % 300).alias("docket"), F.when(k % 4 == 0, None).otherwise(k % 30 + 1990).alias("decided"),
        F.concat("lang", (k % 7).cast("string")).alias("caption"), "source", "doc_id")
    return lookup.docket_groups(r, "docket", ["doc_id"], "decided", "caption", "source", "src3", "doc_id")


@query("w22_hours_per_night", """
SELECT night, count(DISTINCT date_trunc('hour', ts)) AS hours FROM (SELECT ts, (ts - INTERVAL 6 HOUR - INTERVAL 12 HOUR)::DATE AS night
 FROM events) GROUP BY 1""")
def w22(spark, d):
    """Local time is fixed six hours behind UTC in this season; days begin at noon."""
    e = table(spark, d, "events").select(dates.night_of("ts", "America/Chicago").alias("night"),
                                         F.date_trunc("hour", "ts").alias("hour"))
    return e.distinct().groupBy("night").agg(F.count(F.lit(1)).alias("hours"))


@query("j11_nearest_year", """
WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
a AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS want FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT a.*, y, v, row_number() OVER (PARTITION BY a.o_custkey, want ORDER BY abs(y - want), y > want) AS rn FROM a LEFT JOIN f
 USING (o_custkey))
SELECT o_custkey, want, CASE WHEN abs(y - want) <= 3 THEN y END AS y, CASE WHEN abs(y - want) <= 3 THEN round(v, 2) END AS v FROM r
WHERE rn = 1""")
def j11(spark, d):
    o = orders(spark, d).withColumn("y", F.year("day"))
    want = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("y").alias("want")).distinct()
    have = o.where("o_orderstatus = 'F'").select("o_custkey", "y", F.col("o_totalprice").alias("v"))
    return temporal.nearest_year(want, have, ["o_custkey"], "want", "y", ["v"], 3).withColumn("v", F.round("v", 2))


@query("j16_hour_bucket_join", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT event_id, hour, mean FROM events JOIN h ON date_trunc('hour', ts) = hour""")
def j16(spark, d):
    e = table(spark, d, "events")
    h = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"))
    return temporal.hour_join(e.select("event_id", "ts"), h, "ts", "hour").select("event_id", "hour", "mean")


@query("j17_interval_overlap", """
WITH s AS (SELECT o_custkey, o_orderkey AS k, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderdate::DATE +
 (o_orderkey % 60)::INT + 1)::DATE END AS b FROM orders)
SELECT x.o_custkey, x.k AS one, y.k AS two FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.k < y.k
WHERE x.a < coalesce(y.b, DATE '9999-12-31') AND y.a < coalesce(x.b, DATE '9999-12-31')""")
def j17(spark, d):
    o = orders(spark, d)
    s = lambda p: o.select("o_custkey", F.col("o_orderkey").alias(f"{p}k"), F.col("day").alias(f"{p}a"), F.when(
        F.col("o_orderkey") % 11 == 0, None).otherwise(F.date_add("day", (F.col("o_orderkey") % 60 + 1).cast("int")))
        .alias(f"{p}b"))
    j = temporal.overlap_join(s("x"), s("y"), ["o_custkey"], ("xa", "xb"), ("ya", "yb"), ["xk"])
    return j.where("xk < yk").select("o_custkey", F.col("xk").alias("one"), F.col("yk").alias("two"))


_CERT = """c AS (SELECT o_custkey, o_orderkey AS cert, o_orderdate::DATE AS cd, 'FY' || right(((year(o_orderdate) + CASE WHEN
 month(o_orderdate) >= 7 THEN 1 ELSE 0 END))::VARCHAR, 2) AS fy FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT o_custkey, o_orderkey AS sample, o_orderdate::DATE AS sd, 'FY' || right((year(o_orderdate) + CASE WHEN month(o_orderdate)
 >= 7 THEN 1 ELSE 0 END)::VARCHAR, 2) AS fy FROM orders WHERE o_orderstatus = 'O'),
j AS (SELECT s.*, cert, cd, CASE WHEN c.fy = s.fy THEN 1 WHEN cd BETWEEN sd - 60 AND sd + 45 THEN 0 END AS how FROM s JOIN c USING (o_custkey)),
b AS (SELECT sample, arg_max(cert, (how, cd, cert)) AS cert, arg_max(cd, (how, cd, cert)) AS cd, max(how) AS how FROM j WHERE how IS NOT
 NULL GROUP BY 1)"""


def certificates(spark, d):
    o = orders(spark, d).withColumn("fy", dates.fiscal_label("day"))
    c = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("cert"), F.col("day").alias("cd"),
                                              "fy")
    s = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("sample"),
                                              F.col("day").alias("sd"), "fy")
    return temporal.certificate_as_of(s, c, ["o_custkey"], "sample", "sd", "cd", "cert", "fy")


@query("j18_certificate_as_of", f"""
WITH {_CERT} SELECT s.sample, b.cert, b.cd, CASE how WHEN 1 THEN 'fiscal year label' WHEN 0 THEN 'date window' ELSE 'none' END AS
 certificate_by FROM s LEFT JOIN b USING (sample)""")
def j18(spark, d):
    return certificates(spark, d).select("sample", "cert", "cd", "certificate_by")


@query("j18_documents_between", f"""
WITH {_CERT}, d AS (SELECT o_custkey, o_orderdate::DATE AS dd, o_orderpriority AS cl FROM orders WHERE o_orderstatus = 'P')
SELECT s.sample, count(*) FILTER (cl = '1-URGENT' AND dd > b.cd AND dd <= s.sd) - count(*) FILTER (cl = '1-URGENT' AND dd > s.sd AND
 dd <= b.cd) AS n_urgent, count(*) FILTER (cl = '2-HIGH' AND dd > b.cd AND dd <= s.sd) - count(*) FILTER (cl = '2-HIGH' AND dd > s.sd
 AND dd <= b.cd) AS n_high FROM s LEFT JOIN b USING (sample) LEFT JOIN d ON d.o_custkey = s.o_custkey GROUP BY 1""")
def j18_b(spark, d):
    docs = orders(spark, d).where("o_orderstatus = 'P'").select(
        "o_custkey", F.col("day").alias("dd"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(
            F.col("o_orderpriority") == "2-HIGH", "high").alias("cl"))
    r = temporal.documents_between(certificates(spark, d), docs, ["o_custkey"], "sample", "cd", "sd", "dd", "cl",
                                   ["urgent", "high"])
    return r.select("sample", "n_urgent", "n_high")


@query("j19_explained_by_event", """
WITH v AS (SELECT o_orderkey, o_custkey % 20 AS site, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P'),
e AS (SELECT o_custkey % 20 AS site, o_orderdate::DATE AS ed FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT o_orderkey, count(ed) AS events, CASE WHEN count(ed) > 0 THEN 'EXPLAINED' ELSE 'UNEXPLAINED' END AS class FROM v LEFT JOIN e ON
 v.site = e.site AND abs(d - ed) <= 3 GROUP BY 1""")
def j19(spark, d):
    o = orders(spark, d).withColumn("site", F.col("o_custkey") % 20)
    v = o.where("o_orderstatus = 'P'").select("o_orderkey", "site", F.col("day").alias("d"))
    e = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("site", F.col("day").alias("ed"))
    return temporal.explained_by_event(v, e, ["site"], "o_orderkey", "d", "ed").select("o_orderkey", "events", "class")


@query("j20_wind_toward_receptor", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(sin(radians((value * 3.6) % 360))) AS s, avg(cos(radians((value * 3.6) % 360))) AS c
 FROM events GROUP BY 1), r AS (SELECT hour, (degrees(atan2(s, c)) + 360) % 360 AS fr FROM h),
i AS (SELECT event_id, ts, (event_id * 37 % 360)::DOUBLE AS bearing FROM events WHERE event_type = 'error')
SELECT event_id, round(fr, 5) AS wind_from, least(abs((fr + 180) % 360 - bearing), 360 - abs((fr + 180) % 360 - bearing)) <= 45 AS toward
FROM i JOIN r ON date_trunc('hour', ts) = hour""")
def j20(spark, d):
    from fieldbook.functions import geo
    e = table(spark, d, "events")
    a = F.radians(F.col("value") * 3.6 % 360)
    h = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.pmod(F.degrees(F.atan2(
        F.avg(F.sin(a)), F.avg(F.cos(a)))) + 360, F.lit(360.0)).alias("wind_from"))
    i = e.where("event_type = 'error'").select("event_id", "ts", (F.col("event_id") * 37 % 360).cast("double").alias("b"))
    j = temporal.hour_join(i, h, "ts", "hour")
    return j.select("event_id", F.round("wind_from", 5).alias("wind_from"), (geo.angle_difference(
        F.pmod(F.col("wind_from") + 180, F.lit(360.0)), "b") <= 45).alias("toward"))


@query("j20_spike_after_incident", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(sin(radians((value * 3.6) % 360))) AS s, avg(cos(radians((value * 3.6) % 360))) AS c
 FROM events GROUP BY 1), r AS (SELECT hour, (degrees(atan2(s, c)) + 360) % 360 AS fr FROM h),
i AS (SELECT event_id, ts, user_id % 10 AS site, (event_id * 37 % 360)::DOUBLE AS bearing FROM events WHERE event_type = 'error'),
m AS (SELECT event_id AS reading_id, ts AS rts, user_id % 10 AS site, value FROM events WHERE event_type = 'view'),
j AS (SELECT i.event_id, m.*, epoch_us(rts) - epoch_us(ts) AS lag FROM i JOIN m ON m.site = i.site AND rts >= ts AND rts <= ts + INTERVAL 3 HOUR),
p AS (SELECT event_id, count(*) OVER (PARTITION BY event_id) AS readings, value AS peak, lag, rts FROM j
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY value DESC, lag) = 1)
SELECT i.event_id, coalesce(readings, 0) AS readings, peak, round(lag / 60e6, 4) AS lag_min, round(fr, 5) AS wind_from,
 round(least(abs((fr + 180) % 360 - bearing), 360 - abs((fr + 180) % 360 - bearing)), 4) AS off_by,
 CASE WHEN readings IS NULL THEN 'no reading' WHEN fr IS NULL THEN 'no wind' WHEN least(abs((fr + 180) % 360 - bearing),
 360 - abs((fr + 180) % 360 - bearing)) <= 45 THEN 'wind toward receptor' ELSE 'wind elsewhere' END AS reading_of_it
FROM i LEFT JOIN p USING (event_id) LEFT JOIN r ON hour = date_trunc('hour', rts)""")
def j20_b(spark, d):
    from fieldbook.functions import geo
    e = table(spark, d, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    a = F.radians(F.col("value") * 3.6 % 360)
    h = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.pmod(F.degrees(F.atan2(
        F.avg(F.sin(a)), F.avg(F.cos(a)))) + 360, F.lit(360.0)).alias("wind_from"))
    i = e.where("event_type = 'error'").select("event_id", "ts", (F.col("user_id") % 10).alias("site"),
                                               (F.col("event_id") * 37 % 360).cast("double").alias("bearing"))
    m = e.where("event_type = 'view'").select((F.col("user_id") % 10).alias("site"), F.col("ts").alias("rts"), "value",
                                              F.date_trunc("hour", "ts").alias("hour"))
    j = temporal.peak_after(i, m, ["site"], "event_id", "ts", "rts", "value", ["hour"], 3 * 3600).join(h, "hour", "left")
    off = geo.angle_difference(F.pmod(F.col("wind_from") + 180, F.lit(360.0)), "bearing")
    return j.select("event_id", "readings", "peak", F.round(F.col("lag_s") / 60, 4).alias("lag_min"), F.round("wind_from", 5).alias(
        "wind_from"), F.round(off, 4).alias("off_by"), F.when(F.col("readings") == 0, "no reading").when(
            F.col("wind_from").isNull(), "no wind").when(off <= 45, "wind toward receptor").otherwise("wind elsewhere").alias("reading_of_it"))


_EXPO = """m AS (SELECT DISTINCT c_custkey AS member, c_nationkey % 5 AS place, 1970 + c_custkey % 40 AS born FROM customer),
p AS (SELECT o_custkey AS member, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 13 = 0 THEN DATE '2002-12-31' ELSE (o_orderdate::DATE +
 (o_orderkey % 500)::INT)::DATE END AS e FROM orders),
dd AS (SELECT DISTINCT member, d::DATE AS d FROM (SELECT member, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM p)),
day AS (SELECT dd.member, place, d, year(d) AS y, CASE WHEN year(d) % 4 = 0 THEN 366 ELSE 365 END AS n,
 d BETWEEN DATE '1996-03-01' AND DATE '2001-06-30' AS run,
 CASE WHEN d < make_date(born + 2, 7, 1) THEN 10.0 WHEN d < make_date(born + 16, 7, 1) THEN 3.0 ELSE 1.0 END AS f
 FROM dd JOIN m USING (member) WHERE d >= make_date(born, 7, 1)),
yr AS (SELECT member, place, y, count(*) / any_value(n)::DOUBLE AS home, count(*) FILTER (run) / any_value(n)::DOUBLE AS ex,
 coalesce(sum(f) FILTER (run), 0) / any_value(n)::DOUBLE AS w FROM day GROUP BY 1, 2, 3),
ser AS (SELECT c_nationkey % 5 AS place, o_orderpriority AS item, year(o_orderdate) AS y, CASE WHEN o_orderpriority = '2-HIGH' AND
 year(o_orderdate) = 1999 THEN NULL ELSE round(avg(o_totalprice) / 1000, 4) END AS c FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE NOT (o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998) GROUP BY 1, 2, 3),
x AS (SELECT yr.member, i.item, yr.y, home, ex, w, c FROM yr JOIN (SELECT DISTINCT place, item FROM ser) i USING (place)
 LEFT JOIN ser ON ser.place = yr.place AND ser.item = i.item AND ser.y = yr.y),
e AS (SELECT member, item, sum(home) AS residence_years, sum(CASE WHEN c IS NULL AND ex > 0 THEN home - ex ELSE home END) AS known_years,
 sum(CASE WHEN c IS NULL AND ex > 0 THEN 0 ELSE ex END) AS exposed_years, coalesce(sum(c * ex), 0) AS integral,
 coalesce(sum(c * w), 0) AS adaf_integral, count(*) FILTER (c IS NULL AND ex > 0) AS unknown_years FROM x GROUP BY 1, 2)"""


def exposure_results(spark, d):
    o, c = orders(spark, d), table(spark, d, "customer")
    member = c.select(F.col("c_custkey").alias("member"), (F.col("c_nationkey") % 5).alias("place"),
                      (F.col("c_custkey") % 40 + 1970).alias("born"))
    res = o.select(F.col("o_custkey").alias("member"), F.col("day").alias("s"), F.when(
        F.col("o_orderkey") % 13 == 0, None).otherwise(F.date_add("day", (F.col("o_orderkey") % 500).cast("int")))
        .alias("last")).join(member.select("member", "born"), "member")
    years = exposure.home_years(res, "member", "s", "last", "2002-12-31", "born", ("1996-03-01", "2001-06-30"))
    ser = o.join(member, o["o_custkey"] == member["member"]).where(
        ~((F.col("o_orderpriority") == "1-URGENT") & (F.year("day") == 1998))).groupBy(
        "place", F.col("o_orderpriority").alias("item"), F.year("day").alias("year")).agg(
        F.round(F.avg("o_totalprice") / 1000, 4).alias("c"))
    ser = ser.withColumn("c", F.when(~((F.col("item") == "2-HIGH") & (F.col("year") == 1999)), F.col("c")))
    return exposure.exposure(years, member, ser, "member", "place", "item", "c")


@query("a21_exposure_integral", f"""
WITH {_EXPO} SELECT member, item, round(residence_years, 6) AS residence_years, round(known_years, 6) AS known_years,
 round(exposed_years, 6) AS exposed_years, round(integral, 5) AS integral, round(adaf_integral, 5) AS adaf_integral, unknown_years,
 round(known_years / residence_years, 6) AS evidence_fraction FROM e""")
def a21(spark, d):
    e = exposure_results(spark, d)
    return e.select("member", "item", *[F.round(c, 6).alias(c) for c in ("residence_years", "known_years",
                                                                         "exposed_years")],
                    F.round("integral", 5).alias("integral"), F.round(F.coalesce("adaf_integral", F.lit(0.0)), 5)
                    .alias("adaf_integral"), "unknown_years", F.round("evidence_fraction", 6).alias("evidence_fraction"))


@query("a21_period_status", """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'start unknown' WHEN o_orderkey % 9 = 0 AND o_orderkey % 7 < 2 THEN 'ends before it starts'
 ELSE 'counted' END AS status FROM orders""")
def a21_status(spark, d):
    """Periods of residence with whether they count, or why not."""
    k = F.col("o_orderkey")
    start = F.when(k % 50 != 7, F.to_date("o_orderdate"))
    last = F.when(k % 9 == 0, F.date_add(F.to_date("o_orderdate"), (k % 7 - 2).cast("int")))
    return table(spark, d, "orders").select(k, start.alias("s"), last.alias("e")).select(
        "o_orderkey", exposure.period_status("s", "e", "2026-10-11").alias("status"))


_RISK = """k AS (SELECT *, CASE WHEN item = '5-LOW' THEN NULL WHEN item = '3-MEDIUM' THEN 3e-6 * (integral + 0.25 * (adaf_integral -
 integral)) / 70 ELSE 3e-6 * integral / 70 END AS risk, CASE WHEN item = '4-NOT SPECIFIED' OR exposed_years = 0 THEN NULL ELSE integral /
 exposed_years / 37.0 END AS hq FROM e)"""


def risks(spark, d):
    e = exposure_results(spark, d)
    ure = F.when(F.col("item") != "5-LOW", 3e-6)
    rfc = F.when(F.col("item") != "4-NOT SPECIFIED", 37.0)
    return e.select("member", "item", units.cancer_risk("integral", "adaf_integral", ure, F.col("item") == "3-MEDIUM",
                                                        0.25).alias("risk"),
                    units.hazard_quotient("exposed_average", rfc).alias("hq"))


@query("a22_unit_risk_and_quotient", f"""
WITH {_EXPO}, {_RISK} SELECT member, item, round(risk * 1e6, 6) AS risk_per_million, round(hq, 6) AS hq FROM k""")
def a22(spark, d):
    return risks(spark, d).select("member", "item", F.round(F.col("risk") * 1e6, 6).alias("risk_per_million"),
                                  F.round("hq", 6).alias("hq"))


@query("a20_hazard_index_by_organ", f"""
WITH {_EXPO}, {_RISK}, o AS (SELECT * FROM (VALUES ('1-URGENT', 'liver'), ('2-HIGH', 'liver'), ('2-HIGH', 'lung'), ('3-MEDIUM', 'lung'))
 t(item, organ)), h AS (SELECT member, organ, sum(hq) AS hi FROM k JOIN o USING (item) WHERE hq IS NOT NULL GROUP BY 1, 2)
SELECT k.member, round(sum(risk) * 1e6, 5) AS cancer_per_million, count(risk) AS cancer_items, count(*) FILTER (risk IS NULL) AS
 unquantified_cancer, count(*) FILTER (hq IS NULL) AS unquantified_noncancer, (SELECT round(max(hi), 5) FROM h WHERE h.member = k.member)
 AS worst_index, count(*) FILTER (hq IS NOT NULL AND item NOT IN (SELECT item FROM o)) AS unassigned FROM k GROUP BY k.member""")
def a20(spark, d):
    organs = spark.createDataFrame([("1-URGENT", "liver"), ("2-HIGH", "liver"), ("2-HIGH", "lung"),
                                    ("3-MEDIUM", "lung")], "item string, organ string")
    t = exposure.hazard_totals(risks(spark, d), organs, "member", "item", "risk", "hq")
    return t.select("member", F.round(F.col("cancer_risk") * 1e6, 5).alias("cancer_per_million"), "cancer_items",
                    "unquantified_cancer", "unquantified_noncancer", F.round("worst_index", 5).alias("worst_index"),
                    "unassigned")


@query("a25_series_status", """
WITH y AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem),
m AS (SELECT l_suppkey, year(l_shipdate) AS year, sum(l_quantity) AS c FROM lineitem WHERE (l_suppkey + year(l_shipdate)) % 3 <> 0 GROUP BY 1, 2),
f AS (SELECT l_suppkey, year(l_shipdate) AS year, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE sum(l_tax) END AS v FROM lineitem
 WHERE (l_suppkey * 3 + year(l_shipdate)) % 4 <> 0 GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT l_suppkey FROM m), y)
SELECT g.l_suppkey, g.year, CASE WHEN m.c IS NOT NULL THEN 'modeled' WHEN f.v IS NULL THEN 'no_report' WHEN f.v = 0 THEN 'zero_reported'
 ELSE 'reported_not_modeled' END AS status, CASE WHEN m.c IS NOT NULL THEN round(m.c, 2) WHEN f.v = 0 THEN 0 END AS c
FROM g LEFT JOIN m USING (l_suppkey, year) LEFT JOIN f USING (l_suppkey, year)""")
def a25(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    m = li.where((F.col("l_suppkey") + F.col("year")) % 3 != 0).select("l_suppkey", "year", F.col("l_quantity").alias("c"))
    f = li.where((F.col("l_suppkey") * 3 + F.col("year")) % 4 != 0).select("l_suppkey", "year", F.when(
        F.col("l_suppkey") % 5 == 0, 0.0).otherwise(F.col("l_tax")).alias("v"))
    return exposure.series_status(m, f, ["l_suppkey"], li.select("year"), "c", "v").select(
        "l_suppkey", "year", "status", F.round("c", 2).alias("c"))


@query("a6_combined_sources", """
WITH g AS (SELECT l_suppkey % 10 AS site, year(l_shipdate) AS year, l_returnflag AS src, sum(l_quantity) AS c FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT site, year, CASE WHEN (src = 'N' AND year % 2 = 0) OR site = 4 THEN NULL ELSE c END AS c FROM g)
SELECT site, year, round(sum(c), 2) AS c, count(c) > 0 AND count(c) < count(*) AS partial FROM s GROUP BY 1, 2""")
def a6_sources(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site"), F.year("l_shipdate").alias("year"),
                                            F.col("l_returnflag").alias("src"), "l_quantity")
    s = li.groupBy("site", "year", "src").agg(F.sum("l_quantity").alias("c"))
    s = s.withColumn("c", F.when(~(((F.col("src") == "N") & (F.col("year") % 2 == 0)) | (F.col("site") == 4)),
                                 F.col("c")))
    return exposure.combine_sources(s, ["site", "year"], "c").withColumn("c", F.round("c", 2))
