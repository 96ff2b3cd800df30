"""Bearing and location posteriors from group moments, permutation test, highest-density regions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.functions.values import let
from fieldbook.plans.skew import salted_join

# The published arrival-time location failed its own validation; results say so.
LOCATION_VALIDATED = False


def _moments(df: DataFrame, keys: Sequence[str], y: str, speed: str, direction: str) -> DataFrame:
    """Sums that determine the fit prom = a + c U + b U cos(d - t) for every t: one pass, combined map-side."""
    u, d = F.col(speed), F.radians(direction)
    v = {"y": F.col(y), "u": u, "c": u * F.cos(d), "s": u * F.sin(d)}
    names = list(v)
    sums = [F.sum(v[n]).alias(f"s_{n}") for n in names]
    sums += [F.sum(v[a] * v[b]).alias(f"s_{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def _residual(m: DataFrame) -> DataFrame:
    """Inner products of y, c, s after taking out the constant and the speed."""
    det = F.col("n") * F.col("s_uu") - F.col("s_u") * F.col("s_u")

    def inner(a, b):
        za, zb = F.col(f"s_{a}"), F.col(f"s_{b}")
        ua = F.col(f"s_u{a}" if a in "cs" else "s_yu")
        ub = F.col(f"s_u{b}" if b in "cs" else "s_yu")
        raw = F.col(f"s_{a}{b}")
        fit = (za * zb * F.col("s_uu") - (za * ub + ua * zb) * F.col("s_u") + ua * ub * F.col("n")) / F.nullif(det, F.lit(0.0))
        return raw - fit
    return m.withColumns({"yy": inner("y", "y"), "cc": inner("c", "c"), "ss": inner("s", "s"), "cs": inner("c", "s"),
                          "yc": inner("y", "c"), "ys": inner("y", "s")})


def _rss(theta: Column) -> tuple[Column, Column]:
    """(residual sum of squares with b >= 0, b) at a trial direction in degrees."""
    t = F.radians(theta)
    wy = F.cos(t) * F.col("yc") + F.sin(t) * F.col("ys")
    ww = F.cos(t) * F.cos(t) * F.col("cc") + F.lit(2.0) * F.sin(t) * F.cos(t) * F.col("cs") + F.sin(t) * F.sin(t) * F.col("ss")
    b = F.when(ww > 0, wy / F.nullif(ww, F.lit(0.0))).otherwise(0.0)
    return F.when(b > 0, F.col("yy") - wy * wy / F.nullif(ww, F.lit(0.0))).otherwise(F.col("yy")), b


def bearing_posterior(hours: DataFrame, keys: Sequence[str], y: str, speed: str, direction: str, night: str,
                      least_hours: int = 12) -> DataFrame:
    """Posterior over back-azimuths 0 to 359 per key, tempered to one observation per night.

    The rows are reduced to moments first; the 360 trial directions multiply one row per key, not the hours.
    """
    m = _residual(_moments(hours, keys, y, speed, direction)).where(F.col("n") >= least_hours)
    nights = hours.select(*keys, night).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("nights"))
    m = m.join(nights, list(keys)) if keys else m.withColumn("nights", nights.select("nights").scalar())
    rss, b = _rss(F.col("deg").cast("double"))
    g = m.withColumn("deg", F.explode(F.sequence(F.lit(0), F.lit(359)))).withColumns({"__rss": rss, "b": b})
    g = g.withColumn("__ll", -F.col("nights") / 2 * F.log(F.col("__rss") / F.col("n")))
    w = Window.partitionBy(*keys)
    g = g.withColumn("__e", F.exp(F.col("__ll") - F.max("__ll").over(w)))
    return g.select(*keys, "deg", (F.col("__e") / F.sum("__e").over(w)).alias("density"), "b", "n", "nights")


def _statistic() -> Column:
    """log(rss0 / least rss) over all trial directions, inside one row."""
    rss = F.transform(F.sequence(F.lit(0), F.lit(359)), lambda k: _rss(k.cast("double"))[0])
    return F.log(F.col("yy") / F.array_min(rss))


def permutation_p(hours: DataFrame, keys: Sequence[str], y: str, speed: str, direction: str, night: str, hour: str,
                  permutations: int, seed: int = 0) -> DataFrame:
    """Night-block permutation p-value. Nights trade winds as whole blocks, paired hour by hour.

    The shuffles come from hashes of (night, permutation, seed): repeatable under retries, not a generator's stream.
    """
    wn = Window.partitionBy(*keys, night).orderBy(hour)
    h = hours.withColumn("__pos", F.row_number().over(wn))
    nights = h.select(*keys, night).distinct()
    p = nights.withColumn("__p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    by_night = Window.partitionBy(*keys, "__p").orderBy(night)
    by_hash = Window.partitionBy(*keys, "__p").orderBy(F.xxhash64(F.col(night), F.col("__p"), F.lit(seed)), night)
    tgt = p.withColumn("__r", F.row_number().over(by_night))
    src = p.select(*keys, "__p", F.col(night).alias("__src"), F.row_number().over(by_hash).alias("__r"))
    pair = tgt.join(src, [*keys, "__p", "__r"]).select(*keys, "__p", night, "__src")
    left = pair.join(h.select(*keys, night, "__pos", y), [*keys, night])
    wind = h.select(*keys, F.col(night).alias("__src"), "__pos", speed, direction)
    moved = left.join(wind, [*keys, "__src", "__pos"])
    stat = _residual(_moments(moved, [*keys, "__p"], y, speed, direction)).select(*keys, "__p", _statistic().alias("__t"))
    seen = _residual(_moments(hours, keys, y, speed, direction)).select(*keys, _statistic().alias("statistic"))
    j = stat.join(seen, list(keys))
    return j.groupBy(*keys, "statistic").agg(F.count_if(F.col("__t") >= F.col("statistic")).alias("as_extreme")).withColumn(
        "p_value", (F.col("as_extreme") + 1) / F.lit(permutations + 1))


def highest_density(posterior: DataFrame, keys: Sequence[str], order: str, density: str, mass: float = 0.9) -> DataFrame:
    """Flag the smallest set of cells that reaches ``mass`` (a key's cells are a fixed grid)."""
    w = Window.partitionBy(*keys).orderBy(F.col(density).desc(), F.col(order).desc())
    before = F.coalesce(F.sum(density).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return posterior.withColumn("__before", before).withColumn("in_region", F.col("__before") < mass).drop("__before")


def density_arcs(posterior: DataFrame, keys: Sequence[str], mass: float = 0.9) -> DataFrame:
    """Arcs of the highest-density region on the circle, an arc over north kept whole, and their total width."""
    d = highest_density(posterior, keys, "deg", "density", mass).where("in_region")
    w = Window.partitionBy(*keys).orderBy("deg")
    runs = d.withColumn("__r", F.col("deg") - F.row_number().over(w)).groupBy(*keys, "__r").agg(
        F.min("deg").alias("lo"), F.max("deg").alias("hi"))
    wk = Window.partitionBy(*keys)
    runs = runs.withColumns({
        "width": F.sum(F.col("hi") - F.col("lo") + 1).over(wk),
        "__north_lo": F.max(F.when(F.col("hi") == 359, F.col("lo"))).over(wk),
        "__north_hi": F.max(F.when(F.col("lo") == 0, F.col("hi"))).over(wk), "__k": F.count(F.lit(1)).over(wk)})
    wraps = F.col("__north_lo").isNotNull() & F.col("__north_hi").isNotNull() & (F.col("__k") > 1)
    keep = runs.where(~(wraps & (F.col("lo") == 0)))
    return keep.select(*keys, "lo", F.when(wraps & (F.col("hi") == 359), F.col("__north_hi")).otherwise(F.col("hi"))
                       .alias("hi"), "width")


def candidate_density(posterior: DataFrame, candidates: DataFrame, keys: Sequence[str], bearing: str,
                      mass: float = 0.9) -> DataFrame:
    """Each candidate's density relative to the peak and whether it lies in the region."""
    d = highest_density(posterior, keys, "deg", "density", mass)
    d = d.withColumn("relative_density", F.col("density") / F.max("density").over(Window.partitionBy(*keys)))
    c = candidates.withColumn("deg", F.pmod(F.bround(bearing, 0).cast("int"), F.lit(360)))
    return c.join(d.select(*keys, "deg", "relative_density", "in_region"), [*keys, "deg"])


def locate_arrivals(picks: DataFrame, keys: Sequence[str], center: tuple[float, float], box: float, step: float,
                    celerities: Sequence[float], sigma: float, eps: float, window_s: float, dt: float) -> DataFrame:
    """Posterior over a grid from arrival picks, summed over origin time and celerity.

    ``picks`` has station, lat, lon, t (seconds from the reference time) and weight. A station's term is a mixture of its
    picks being the arrival and none of them being it. Picks of one moment are added first; then every (pick, cell,
    celerity, origin time) is a row, its term is summed by station, the stations' logarithms by hypothesis, and the
    hypotheses by cell as a log-sum-exp. Nothing is gathered: a station with a third of all picks is spread, and what is
    summed is combined before it travels. ``validated`` is false.
    """
    place = [*keys, "station"]
    once = picks.groupBy(*place, "t").agg(F.sum("weight").alias("weight"))
    total = picks.groupBy(*place).agg(F.sum("weight").alias("__total"))
    n = int(round(2 * box / step))
    axis = lambda c: F.explode(F.array(*[F.lit(c - box + i * step) for i in range(n + 1)]))
    cells = picks.select(*place, "lat", "lon").distinct().withColumn("glat", axis(center[0])).withColumn("glon", axis(center[1]))
    cells = cells.withColumn("__d", geo.haversine("lat", "lon", "glat", "glon", geo.RADIUS_KM))
    reach = cells.groupBy(*keys).agg(F.max("__d").alias("__far"))
    rays = (cells.join(reach, list(keys)).join(total, place)
            .withColumn("cel", F.explode(F.array(*[F.lit(float(c)) for c in celerities]))).drop("lat", "lon"))
    t_lo = -F.col("__far") / min(celerities)
    steps = F.floor((F.lit(window_s) - t_lo + 1e-9) / dt).cast("int")
    rows = salted_join(once, rays, place, ["t"], rows_per_split=10_000, pairs_per_split=1_000_000)
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), steps)))
    miss = (F.col("t") - (t_lo + F.col("__k") * dt) - F.col("__d") / F.col("cel")) / sigma
    term = F.col("weight") / F.col("__total") * F.exp(F.lit(-0.5) * miss * miss) / (sigma * math.sqrt(2 * math.pi))
    cell = [*keys, "glat", "glon"]
    mix = rows.groupBy(*cell, "cel", "__k", "station").agg(F.sum(term).alias("__mix"))
    ll = mix.groupBy(*cell, "cel", "__k").agg(F.sum(F.log(F.col("__mix") * (1 - eps) + eps / window_s)).alias("__ll"))
    top = F.max("__ll").over(Window.partitionBy(*cell))  # of a cell's hypotheses, as many as celerities and origin times
    lp = ll.withColumn("__m", top).groupBy(*cell, "__m").agg(F.sum(F.exp(F.col("__ll") - F.col("__m"))).alias("__z"))
    w = Window.partitionBy(*keys)  # over the grid's cells
    lp = lp.withColumn("__lp", F.col("__m") + F.log("__z")).withColumn("__e", F.exp(F.col("__lp") - F.max("__lp").over(w)))
    return lp.select(*cell, (F.col("__e") / F.sum("__e").over(w)).alias("density"), F.lit(LOCATION_VALIDATED).alias("validated"))


def region_stats(posterior: DataFrame, keys: Sequence[str], step: float, mass: float = 0.9) -> DataFrame:
    """Cells, area, extent along and across the long axis of the highest-density region, and whether it meets the edge."""
    d = posterior.withColumn("__o", F.struct("glat", "glon"))
    d = highest_density(d, keys, "__o", "density", mass)
    edge = d.groupBy(*keys).agg(F.min("glat").alias("a0"), F.max("glat").alias("a1"), F.min("glon").alias("o0"), F.max("glon").alias("o1"),
                                F.max_by(F.struct("glat", "glon"), "density").alias("at"))
    km = 111.195
    r = d.where("in_region").join(edge, list(keys)).withColumns({
        "x": (F.col("glon") - F.col("at.glon")) * km * F.cos(F.radians("at.glat")), "y": (F.col("glat") - F.col("at.glat")) * km})
    on_edge = (F.col("glat") == F.col("a0")) | (F.col("glat") == F.col("a1")) | (F.col("glon") == F.col("o0")) | (F.col("glon") == F.col("o1"))
    m = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.lit((step * km) ** 2) * F.cos(F.radians("glat"))).alias("area_km2"),
        F.bool_or(on_edge).alias("touches_grid_edge"), F.min("glat").alias("lat_min"), F.max("glat").alias("lat_max"),
        F.min("glon").alias("lon_min"), F.max("glon").alias("lon_max"), F.covar_pop("x", "y").alias("__xy"),
        F.var_pop("x").alias("__xx"), F.var_pop("y").alias("__yy"))
    m = m.withColumn("__t", F.when(F.col("cells") > 2, F.atan2(F.col("__xy") * 2, F.col("__xx") - F.col("__yy")) / 2)
                     .otherwise(math.pi / 2))
    p = r.join(m.select(*keys, "__t"), list(keys)).groupBy(*keys).agg(
        (F.max(F.col("x") * F.cos("__t") + F.col("y") * F.sin("__t")) - F.min(F.col("x") * F.cos("__t") + F.col("y") * F.sin("__t"))
         + step * km).alias("length_km"),
        (F.max(F.col("y") * F.cos("__t") - F.col("x") * F.sin("__t")) - F.min(F.col("y") * F.cos("__t") - F.col("x") * F.sin("__t"))
         + step * km).alias("width_km"))
    axis = F.pmod(F.degrees(F.lit(math.pi / 2) - F.col("__t")), F.lit(180.0))
    return m.withColumn("long_axis_deg", axis).join(p, list(keys)).drop("__xy", "__xx", "__yy", "__t")
