"""Spectra, bearings, locations and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldbook.catalog.registry import query
from fieldbook.functions import dates, values
from fieldbook.operators import inference, joins, rollups, series, temporal
from fieldbook.sources import table
from fieldbook.streaming import runs


def spectra(spark, d):
    """Embedding vectors as spectra: bin i at i + 1 Hz, levels scaled to decibels."""
    n = F.size("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("double")).alias("freqs"),
        F.transform("embedding", lambda v: v.cast("double") * 100).alias("levels"))


_SPEC = """e AS (SELECT vec_id, label, generate_subscripts(embedding, 1)::BIGINT AS b, unnest(embedding)::DOUBLE * 100 AS v FROM embeddings),
p AS (SELECT x.vec_id, x.label, x.b, x.v, x.v - median(y.v) AS pr FROM e x JOIN e y ON x.vec_id = y.vec_id AND y.b >= x.b / pow(2, 1 / 3.0) AND y.b <= x.b *
 pow(2, 1 / 3.0) GROUP BY x.vec_id, x.label, x.b, x.v)"""


@query("w12_prominence", f"WITH {_SPEC} SELECT vec_id, b - 1 AS bin, round(pr, 6) AS prominence_db FROM p")
def w12(spark, d):
    s = spectra(spark, d).select("vec_id", F.posexplode(series.prominence("freqs", "levels")).alias("bin", "p"))
    return s.select("vec_id", "bin", F.round("p", 6).alias("prominence_db"))


@query("w12_peaks_with_suppression")
def w12_b(spark, d):
    """Peaks with the three-bin rule, which depends on the order of bins (rows only; tested against a plain loop)."""
    return series.peaks(spectra(spark, d), ["vec_id"], "freqs", "levels", (3.0, 60.0), 8.0)


@query("g13_level_features", f"""WITH {_SPEC}, w AS (SELECT unnest([8, 20, 41]) AS hz),
c AS (SELECT vec_id, hz, p.b, v, pr, row_number() OVER (PARTITION BY vec_id, hz ORDER BY v DESC, p.b) AS r FROM p, w WHERE p.b BETWEEN hz - 2 AND hz + 2)
SELECT vec_id, hz::DOUBLE AS hz, b - 1 AS bin, round(v, 6) AS level_db, round(pr, 6) AS prominence_db FROM c WHERE r = 1""")
def g13(spark, d):
    f = series.level_features(spectra(spark, d), ["vec_id"], "freqs", "levels", [8.0, 20.0, 41.0])
    return f.withColumns({c: F.round(c, 6) for c in ("level_db", "prominence_db")})


_SEG = """x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 11 <> 0),
s AS (SELECT vec_id, k, i - 8 * k AS t, v FROM x, range(7) r(k) WHERE i >= 8 * k AND i < 8 * k + 16)"""


@query("g9_welch_spectra", f"""WITH {_SEG}, m AS (SELECT vec_id, k, regr_slope(v, t) AS a, regr_intercept(v, t) AS b FROM s GROUP BY 1, 2),
d AS (SELECT s.vec_id, s.k, t, (v - a * t - b) * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS z FROM s JOIN m USING (vec_id, k)),
f AS (SELECT vec_id, k, q, sum(z * cos(2 * pi() * q * t / 16)) AS re, sum(z * sin(2 * pi() * q * t / 16)) AS im FROM d, range(9) r(q) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, q, avg(re * re + im * im) / 6.0 * CASE WHEN q IN (0, 8) THEN 1 ELSE 2 END AS p FROM f GROUP BY 1, 2)
SELECT vec_id, q AS bin, q / 16.0::DOUBLE AS hz, round(10 * log10(p), 5) AS db FROM p WHERE q > 0""")
def g9(spark, d):
    """Traces are the embedding vectors; every eleventh one has a gap and is dropped."""
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where(
        ~((F.col("vec_id") % 11 == 0) & (F.col("i") == 30)))
    w = series.welch_spectra(series.whole_hours(t, ["vec_id"], "i", "v", 64), ["vec_id"], 1.0, 16)
    s = w.select("vec_id", F.posexplode(F.arrays_zip("freqs", "levels")).alias("bin", "z")).where("bin > 0")
    return s.select("vec_id", "bin", F.col("z.freqs").alias("hz"), F.round("z.levels", 5).alias("db"))


@query("g9_pooled_coherence", """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT vec_id, k, i - 8 * k AS t, v FROM x, range(7) r(k) WHERE i >= 8 * k AND i < 8 * k + 16),
d AS (SELECT vec_id, k, t, (v - avg(v) OVER (PARTITION BY vec_id, k)) * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS z FROM s),
f AS (SELECT vec_id, k, q, sum(z * cos(2 * pi() * q * t / 16)) AS re, -sum(z * sin(2 * pi() * q * t / 16)) AS im FROM d, range(9) r(q) GROUP BY 1, 2, 3),
c AS (SELECT a.vec_id // 2 % 10 AS grp, a.q, sum(a.re * a.re + a.im * a.im) AS xx, sum(b.re * b.re + b.im * b.im) AS yy, sum(a.re * b.re + a.im * b.im) AS re,
 sum(a.re * b.im - a.im * b.re) AS im, count(DISTINCT a.vec_id) AS hours FROM f a JOIN f b ON b.vec_id = a.vec_id + 1 AND a.k = b.k AND a.q = b.q WHERE a.vec_id % 2 = 0
 GROUP BY 1, 2)
SELECT grp, q AS bin, round((re * re + im * im) / (xx * yy), 6) AS coherence, hours FROM c WHERE q > 0""")
def g9_b(spark, d):
    e, k = table(spark, d, "embeddings"), F.col("vec_id")
    a = e.where(k % 2 == 0).select(F.floor(k / 2).alias("h"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    b = e.where(k % 2 == 1).select(F.floor(k / 2).alias("h"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))
    p = a.join(b, "h").withColumn("grp", F.col("h") % 10)
    return series.pooled_coherence(p, ["grp"], "x", "y", 1.0, 16).where("bin > 0").select(
        "grp", "bin", F.round("coherence", 6).alias("coherence"), "hours")


@query("g10_before_after_spectra")
def g10(spark, d):
    """New peaks after against before (rows only: the peak rule is sequential; tested against a plain loop)."""
    s = spectra(spark, d)
    return series.compare_spectra(s.where("label < 5"), s.where("label >= 5"), "freqs", "levels", (3.0, 60.0), 0.6, 0.2)


@query("g10_window_notes", """
WITH h AS (SELECT DISTINCT user_id, (event_id % 5 = 0)::INT AS s, date_trunc('hour', ts + to_days((event_id % 5 * (user_id % 2) * 20)::INT)) AS h FROM events),
m AS (SELECT user_id, month(h) AS m, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM h GROUP BY 1, 2),
g AS (SELECT user_id, sum(a)::BIGINT AS hours_before, sum(b)::BIGINT AS hours_after, count(*) FILTER (a > 0 AND b > 0) AS shared_months FROM m GROUP BY 1)
SELECT *, shared_months = 0 AS no_shared_month, hours_before < 25 AS thin_before, hours_after < 10 AS thin_after FROM g""")
def g10_b(spark, d):
    """Hours of two windows; channels of odd number were moved by up to eighty days in the first one."""
    k = F.col("event_id") % 5
    e = table(spark, d, "events").select("user_id", k.alias("k"), F.timestamp_add("DAY", (k * (F.col("user_id") % 2) * 20).cast("int"), F.col("ts")).alias("ts"))
    return series.window_notes(e.where("k <> 0"), e.where("k = 0"), ["user_id"], "ts", (50, 20))


def wind_hours(spark, d):
    """Hourly feature and wind of three stations."""
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("station"), "ts", "value",
                                         values.nested("props", "k").cast("int").alias("k"))
    f = e.groupBy("station", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("y"))
    w = rollups.hourly_wind(e.select("station", "ts", (F.col("k") * 3.6).cast("string").alias("dr"), (F.col("value") / 10).cast(
        "string").alias("sp")), ["station"], "ts", "dr", "sp").select("station", "hour", "speed", "from_deg")
    return f.join(w, ["station", "hour"]).withColumn("night", dates.night_of("hour", "America/Chicago"))


_WH = """e AS (SELECT user_id % 3 AS station, ts, value, (props->>'$.k')::BIGINT AS k FROM events),
h AS (SELECT station, date_trunc('hour', ts) AS hour, avg(value) AS y, avg(CASE WHEN value = 0 THEN 0 ELSE value / 10 * sin(radians(k * 3.6)) END) AS u,
 avg(CASE WHEN value = 0 THEN 0 ELSE value / 10 * cos(radians(k * 3.6)) END) AS v FROM e GROUP BY 1, 2),
w AS (SELECT station, hour, y, sqrt(u * u + v * v) AS sp, u AS us, v AS uc, (hour - INTERVAL 18 HOUR)::DATE AS night FROM h),
g AS (SELECT station, count(*) AS n, count(DISTINCT night) AS nights, regr_slope(y, sp) AS ya, regr_intercept(y, sp) AS yb, regr_slope(uc, sp) AS ca,
 regr_intercept(uc, sp) AS cb, regr_slope(us, sp) AS sa, regr_intercept(us, sp) AS sb FROM w GROUP BY 1),
r AS (SELECT w.station, n, nights, y - ya * sp - yb AS ry, uc - ca * sp - cb AS rc, us - sa * sp - sb AS rs FROM w JOIN g USING (station)),
m AS (SELECT station, any_value(n) AS n, any_value(nights) AS nights, sum(ry * ry) AS yy, sum(rc * rc) AS cc, sum(rs * rs) AS ss, sum(rc * rs) AS cs, sum(ry * rc) AS yc,
 sum(ry * rs) AS ys FROM r GROUP BY 1),
q AS (SELECT m.*, deg, cos(radians(deg)) * yc + sin(radians(deg)) * ys AS wy, pow(cos(radians(deg)), 2) * cc + 2 * sin(radians(deg)) * cos(radians(deg)) * cs +
 pow(sin(radians(deg)), 2) * ss AS ww FROM m, range(360) t(deg)),
l AS (SELECT station, deg, n, nights, wy / ww AS b, -nights / 2 * ln(CASE WHEN wy > 0 THEN yy - wy * wy / ww ELSE yy END / n) AS ll FROM q),
x AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY station)) AS e FROM l),
post AS (SELECT station, deg, b, e / sum(e) OVER (PARTITION BY station) AS density FROM x)"""


@query("g4_bearing_posterior", f"WITH {_WH} SELECT station, deg, round(density, 7) AS density, round(b, 6) AS b FROM post")
def g4(spark, d):
    p = inference.bearing_posterior(wind_hours(spark, d), ["station"], "y", "speed", "from_deg", "night")
    return p.select("station", "deg", F.round("density", 7).alias("density"), F.round("b", 6).alias("b"))


@query("g5_permutation_p_value")
def g5(spark, d):
    """Night-block permutations with hashed shuffles (rows only: no engine shares the shuffle)."""
    return inference.permutation_p(wind_hours(spark, d), ["station"], "y", "speed", "from_deg", "night", "hour", 99, 7)


@query("g6_highest_density_arcs", f"""WITH {_WH}, o AS (SELECT *, sum(density) OVER (PARTITION BY station ORDER BY density DESC, deg DESC ROWS UNBOUNDED PRECEDING) - density AS
 before FROM post), k AS (SELECT station, deg FROM o WHERE before < 0.9), c AS (SELECT station, deg, deg - row_number() OVER (PARTITION BY station ORDER BY deg) AS r FROM k),
a AS (SELECT station, min(deg) AS lo, max(deg) AS hi FROM c GROUP BY station, r), n AS (SELECT station, count(*) AS k, bool_or(lo = 0) AND bool_or(hi = 359) AND count(*) > 1 AS
 wraps, max(hi) FILTER (lo = 0) AS nh, sum(hi - lo + 1)::BIGINT AS width FROM a GROUP BY 1)
SELECT station, lo, CASE WHEN wraps AND hi = 359 THEN nh ELSE hi END AS hi, width FROM a JOIN n USING (station) WHERE NOT (wraps AND lo = 0)""")
def g6(spark, d):
    p = inference.bearing_posterior(wind_hours(spark, d), ["station"], "y", "speed", "from_deg", "night")
    return inference.density_arcs(p, ["station"])


@query("g6_candidate_density", f"""WITH {_WH}, o AS (SELECT *, density / max(density) OVER (PARTITION BY station) AS rel, sum(density) OVER (PARTITION BY station ORDER BY density
 DESC, deg DESC ROWS UNBOUNDED PRECEDING) - density AS before FROM post), c AS (SELECT s_suppkey, s_suppkey % 3 AS station, s_suppkey * 17 % 360 AS deg FROM supplier)
SELECT s_suppkey, station, round(rel, 6) AS relative_density, before < 0.9 AS in_region FROM c JOIN o USING (station, deg)""")
def g6_b(spark, d):
    p = inference.bearing_posterior(wind_hours(spark, d), ["station"], "y", "speed", "from_deg", "night")
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k, (k % 3).alias("station"), (k * 17 % 360).cast("double").alias("bearing"))
    return inference.candidate_density(p, c, ["station"], "bearing").select(
        "s_suppkey", "station", F.round("relative_density", 6).alias("relative_density"), "in_region")


_PICKS = """pk AS (SELECT day(ts) AS shot, user_id % 4 AS station, 30.0::DOUBLE + (user_id % 4) * 0.4 AS lat, -91.0::DOUBLE + (user_id % 4 * 7 % 5) * 0.3 AS lon,
  100.0::DOUBLE + (event_id * 37 % 400) AS t, 1.0::DOUBLE + event_id % 3 AS weight FROM events),
ws AS (SELECT *, weight / sum(weight) OVER (PARTITION BY shot, station) AS w FROM pk)"""


def picks(spark, d):
    u, k = F.col("user_id") % 4, F.col("event_id")
    return table(spark, d, "events").select(
        F.dayofmonth("ts").alias("shot"), u.alias("station"), (u * 0.4 + 30.0).alias("lat"), ((u * 7 % 5) * 0.3 - 91.0).alias("lon"),
        (k * 37 % 400 + 100.0).alias("t"), (k % 3 + 1.0).alias("weight"))


def location(spark, d):
    return inference.locate_arrivals(picks(spark, d), ["shot"], (30.5, -90.5), 1.0, 0.5, [0.28, 0.34], 20.0, 0.1, 600.0, 60.0)


_LOC = f"""WITH {_PICKS}, gr AS (SELECT DISTINCT shot, 29.5::DOUBLE + i * 0.5 AS glat, -91.5::DOUBLE + j * 0.5 AS glon FROM pk, range(5) a(i), range(5) b(j)),
ds AS (SELECT g.shot, glat, glon, s.station, 2 * 6371.0 * asin(sqrt(pow(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon)
 / 2), 2))) AS dk FROM gr g JOIN (SELECT DISTINCT shot, station, lat, lon FROM pk) s USING (shot)),
rc AS (SELECT shot, max(dk) AS far FROM ds GROUP BY 1),
tt AS (SELECT shot, cel, -far / 0.28 + k * 60.0 AS t0 FROM rc, (SELECT unnest([0.28, 0.34])::DOUBLE AS cel), range(200) r(k) WHERE k <= floor((600 + far / 0.28 + 1e-9) / 60.0)),
mx AS (SELECT ds.shot, glat, glon, station, cel, t0, sum(w * exp(-0.5 * pow((t - t0 - dk / cel) / 20.0, 2))) / (20.0 * sqrt(2 * pi())) AS mix FROM ds JOIN tt USING (shot) JOIN ws
 USING (shot, station) GROUP BY ALL),
ll AS (SELECT shot, glat, glon, cel, t0, sum(ln(0.9 * mix + 0.1 / 600.0)) AS ll FROM mx GROUP BY ALL),
lm AS (SELECT shot, glat, glon, cel, max(ll) AS m, list(ll) AS ls FROM ll GROUP BY 1, 2, 3, 4),
lc AS (SELECT shot, glat, glon, m + ln(list_sum(list_transform(ls, lambda v: exp(v - m))) * 60.0) AS lm FROM lm),
lp AS (SELECT shot, glat, glon, max(lm) + ln(sum(exp(lm - mm))) AS lp FROM (SELECT *, max(lm) OVER (PARTITION BY shot, glat, glon) AS mm FROM lc) GROUP BY 1, 2, 3),
ex AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY shot)) AS e FROM lp), po AS (SELECT shot, glat, glon, e / sum(e) OVER (PARTITION BY shot) AS density FROM ex)"""


@query("g7_arrival_time_location", f"{_LOC} SELECT shot, glat, glon, round(density, 7) AS density, false AS validated FROM po")
def g7(spark, d):
    return location(spark, d).withColumn("density", F.round("density", 7))


@query("g6_region_extent", f"""{_LOC}, o AS (SELECT *, sum(density) OVER (PARTITION BY shot ORDER BY density DESC, glat DESC, glon DESC ROWS UNBOUNDED PRECEDING) - density AS before
 FROM po), k AS (SELECT * FROM o WHERE before < 0.9)
SELECT shot, count(*) AS cells, round(sum(pow(0.5 * 111.195, 2) * cos(radians(glat))), 3) AS area_km2, min(glat) AS lat_min, max(glat) AS lat_max,
 bool_or(glat IN (29.5, 31.5) OR glon IN (-91.5, -89.5)) AS touches_grid_edge FROM k GROUP BY 1""")
def g6_c(spark, d):
    return inference.region_stats(location(spark, d), ["shot"], 0.5).select(
        "shot", "cells", F.round("area_km2", 3).alias("area_km2"), "lat_min", "lat_max", "touches_grid_edge")


_STORM = """c AS (SELECT date_trunc('hour', ts) AS hour, ((epoch(date_trunc('hour', ts)) / 3600)::BIGINT * 37 % 360 + event_id % 50)::DOUBLE % 360 AS bearing,
 2.5::DOUBLE + event_id * 7 % 40 AS km FROM events WHERE (props->>'$.k')::BIGINT >= 40)"""


def storm_cells(spark, d):
    e = table(spark, d, "events").where(values.nested("props", "k").cast("int") >= 40)
    h = F.date_trunc("hour", "ts")
    return e.select(h.alias("hour"), (((F.unix_timestamp(h) / 3600).cast("long") * 37 % 360 + F.col("event_id") % 50).cast("double") % 360)
                    .alias("bearing"), (F.col("event_id") * 7 % 40 + 2.5).alias("km"))


@query("g12_one_sided_storm_hours", f"""WITH {_STORM}, i AS (SELECT * FROM c WHERE km <= 50), d AS (SELECT hour, bearing, lead(bearing) OVER w AS nx, first_value(bearing) OVER w AS f
 FROM (SELECT DISTINCT hour, bearing FROM i) WINDOW w AS (PARTITION BY hour ORDER BY bearing)),
s AS (SELECT hour, 360 - max(coalesce(nx - bearing, f + 360 - bearing)) AS spread FROM d GROUP BY 1),
g AS (SELECT hour, count(*) FILTER (km BETWEEN 3 AND 25) AS cells, count(*) FILTER (km < 3) AS close, list(km ORDER BY km) FILTER (km BETWEEN 3 AND 25) AS l FROM i GROUP BY 1),
j AS (SELECT hour, cells, l[len(l) // 2 + 1] AS median_km, spread FROM g JOIN s USING (hour) WHERE cells >= 3 AND close = 0 AND spread <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY hour::DATE ORDER BY cells DESC, median_km, hour) AS place FROM j)
SELECT hour, cells, median_km, round(spread, 6) AS spread_deg, place FROM r WHERE place <= 2""")
def g12(spark, d):
    r = series.one_sided_hours(storm_cells(spark, d), [], "hour", "km", "bearing", 25.0, 60.0, 2)
    return r.select("hour", "cells", "median_km", F.round("spread_deg", 6).alias("spread_deg"), "place")


@query("g12_validation_score", """WITH e AS (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id * 13 % 180)::DOUBLE END AS axis, (event_id * 29 % 360)::DOUBLE AS truth FROM events
 WHERE event_type = 'click'), d AS (SELECT axis, truth, least(abs(axis - truth), 360 - abs(axis - truth)) AS a, least(abs(axis + 180 - truth), 360 - abs(axis + 180 - truth)) AS b
 FROM e WHERE axis IS NOT NULL), g AS (SELECT count(*) AS scored, count(*) FILTER (least(a, b) <= 20) AS hits, count(*) FILTER (least(a, b) <= 20 AND a <= 90) AS toward FROM d)
SELECT *, hits >= 3 AND (toward = 0 OR toward = hits) AND hits * 2 >= scored AS passes FROM g""")
def g12_b(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").where("event_type = 'click'").select(F.when(k % 4 != 0, (k * 13 % 180).cast("double")).alias("axis"), (
        k * 29 % 360).cast("double").alias("truth"))
    return series.validation_score(e, "axis", "truth")


@query("x1_monitor_new_keys", "SELECT DISTINCT user_id, event_type FROM events")
def x1(spark, d):
    s = runs.read_stream(spark, d, "events").select("user_id", "event_type")
    return spark.read.parquet(runs.drain_first_seen(s, ["user_id", "event_type"], "monitor")).select("user_id", "event_type")


@query("x2_tumbling_hours", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def x2(spark, d):
    s = runs.tumbling(runs.read_stream(spark, d, "events"), "ts", ["event_type"], "1 hour", [
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return runs.latest_rows(spark, runs.drain(s, "update", "hours"), ["start", "event_type"]).withColumn(
        "total", F.round("total", 4))


@query("x3_sliding_sensor_means", """
WITH s AS (SELECT ts, value, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM events)
SELECT b - to_minutes(10 * k) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM s, range(6) t(k) GROUP BY 1""")
def x3(spark, d):
    s = runs.tumbling(runs.read_stream(spark, d, "events"), "ts", [], "60 minutes", [
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")], slide="10 minutes")
    return runs.latest_rows(spark, runs.drain(s, "update", "sensor"), ["start"]).withColumn("mean", F.round("mean", 6))


@query("x3_event_lag_stream", """
SELECT e.event_id, r.event_id AS reading_id, (epoch_us(r.ts) - epoch_us(e.ts)) / 1e6 AS lag_s, r.value FROM events e
JOIN events r ON e.user_id % 10 = r.user_id % 10 AND r.ts >= e.ts AND r.ts <= e.ts + INTERVAL 90 MINUTE
WHERE e.event_type = 'error' AND r.event_type = 'view'""")
def x3_lag(spark, d):
    site = (F.col("user_id") % 10).alias("site")
    r = runs.read_stream(spark, d, "events").where("event_type = 'view'").select(
        site, F.col("event_id").alias("reading_id"), F.col("ts").alias("read_at"), "value")
    e = runs.read_stream(spark, d, "events").where("event_type = 'error'").select(site, "event_id", "ts")
    j = runs.event_lag(r, e, ["site"], "read_at", "ts", "90 minutes", packed=True)
    lists = spark.read.parquet(runs.drain(j, "append", "lag")).drop("batch")
    return runs.lag_pairs(lists, "read_at", "ts", "90 minutes").select("event_id", "reading_id", "lag_s", "value")


@query("x4_state_transitions", """
WITH p AS (SELECT user_id, event_id, (props->>'$.k')::BIGINT % 3 <> 0 AS o, lag((props->>'$.k')::BIGINT % 3 <> 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, event_id, CASE WHEN o THEN 'START-UP' ELSE 'SHUTDOWN' END AS event FROM p WHERE prev IS NOT NULL AND prev <> o""")
def x4(spark, d):
    e = runs.read_stream(spark, d, "events").select(
        "user_id", "ts", "event_id", (values.nested("props", "k").cast("int") % 3 != 0).alias("on"))
    return spark.read.parquet(runs.drain(runs.state_changes(e, "user_id", "ts", "event_id", "on"), "append", "states")).select(
        "user_id", "event_id", "event")


_TRIG = """r AS (SELECT user_id, event_id, ts, row_number() OVER w AS p, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS sta,
 avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING) AS lta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, CASE WHEN p >= 12 THEN sta / lta END AS ratio FROM r),
m AS (SELECT *, CASE WHEN ratio >= 1.6 THEN 1 WHEN ratio < 0.9 THEN 0 END AS mark FROM q),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING), 0) AS st FROM m),
o AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY p), 0) AS pst FROM s)"""


@query("x5_trigger_sessions", f"""WITH {_TRIG}, n AS (SELECT *, sum(CASE WHEN st = 1 AND pst = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS ss FROM o)
SELECT user_id, ss::BIGINT AS session, min(p) AS start, max(p) AS "end", round(max(ratio), 6) AS peak, count(*) AS rows FROM n WHERE st = 1 GROUP BY 1, 2""")
def x5(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    r = series.trigger_ratio(e, ["user_id"], ["ts", "event_id"], "value", 3, 12)
    s = temporal.trigger_sessions(r, ["user_id"], "pos", "ratio", 1.6, 0.9)
    return s.select("user_id", "session", "start", "end", F.round("peak", 6).alias("peak"), "rows")


@query("x5_trigger_marks_stream", f"""WITH {_TRIG} SELECT user_id, event_id, CASE WHEN st = 1 THEN 'on' ELSE 'off' END AS mark FROM o WHERE st <> pst""")
def x5_b(spark, d):
    e = runs.read_stream(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return spark.read.parquet(runs.drain(runs.trigger_events(e, "user_id", "ts", "event_id", "value", 3, 12, 1.6, 0.9), "append",
                                         "trigger")).select("user_id", "event_id", "mark")


@query("x6_new_notices_with_deadline", """
WITH n AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders WHERE o_orderdate::DATE <= DATE '1999-06-15' AND o_orderdate::DATE + 45 >= DATE '1999-06-15' GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS open_notices FROM n""")
def x6(spark, d):
    o = runs.read_stream(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("ts"))
    o = o.withColumns({"opens": F.to_date("ts"), "closes": F.date_add(F.to_date("ts"), 45)})
    s = joins.open_periods(o, "opens", "closes", "1999-06-15").select("o_custkey", "o_orderpriority", "closing_soon")
    got = spark.read.parquet(runs.drain_first_seen(s, ["o_custkey", "o_orderpriority"], "notices"))
    per = got.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("open_notices"))
    return got.select("o_custkey", "o_orderpriority").join(per, "o_custkey")
