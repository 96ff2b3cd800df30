"""Spectra and level series: prominence, peaks, Welch spectra, coherence, comparison, trigger ratio."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.functions.values import let
from fieldbook.plans.ordered import running
from fieldbook.plans.quantiles import exact_quantiles

OCTAVE = 1.0 / 3.0


def _median(values: Column) -> Column:
    """Middle of an array, the two middle ones averaged."""
    def mid(s):
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    return F.when(F.size(values) > 0, let(F.array_sort(values), mid))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def prominence(freqs: str, levels: str, octave: float = OCTAVE) -> Column:
    """Array of levels above the median within +-``octave`` of each frequency (null where not defined).

    One spectrum's bins are one array; spectra spread over the cluster.
    """
    pairs = F.zip_with(F.col(freqs), F.col(levels), lambda f, v: F.struct(f.cast("double").alias("f"),
                                                                           v.cast("double").alias("v")))
    k = 2.0 ** octave

    def one(p, all_):
        band = F.filter(all_, lambda q: (q.f >= p.f / k) & (q.f <= p.f * k) & _finite(q.v))
        return F.when((p.f > 0) & _finite(p.v), p.v - _median(F.transform(band, lambda q: q.v)))
    return let(pairs, lambda all_: F.transform(all_, lambda p: one(p, all_)))


def peaks(spectra: DataFrame, keep: Sequence[str], freqs: str, levels: str, band: tuple[float, float],
          min_db: float) -> DataFrame:
    """Local maxima with enough prominence; within three bins of the last kept peak only the stronger one stays."""
    d = spectra.withColumn("__pr", prominence(freqs, levels))
    n = F.size(levels)
    at = lambda c, i: F.element_at(F.col(c), i)

    def cand(i):
        f, v, pr = at(freqs, i), at(levels, i).cast("double"), at("__pr", i)
        ok = f.between(*band) & pr.isNotNull() & (v >= at(levels, i - 1)) & (v >= at(levels, i + 1)) & (pr >= min_db)
        return F.when(ok, F.struct((i - 1).alias("i"), f.cast("double").alias("hz"), v.alias("db"), pr.alias("prominence_db")))
    found = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), cand), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<i:int,hz:double,db:double,prominence_db:double>>")

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        near = last.isNotNull() & (p.i - last["i"] <= 3)
        cut = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (F.when(near & (p.prominence_db > last["prominence_db"]), F.concat(cut, F.array(p)))
                .when(near, acc).otherwise(F.concat(acc, F.array(p))))
    out = F.when(n >= 3, F.aggregate(found, empty, step))
    return d.select(*keep, F.explode(out).alias("p")).select(*keep, "p.*")


def strongest_near(freqs: str, levels: str, hz: float, width: int = 2) -> Column:
    """1-based bin of the highest level within ``width`` bins of the one nearest to ``hz``."""
    dist = F.transform(F.col(freqs), lambda f, i: F.struct(F.abs(f - hz).alias("d"), (i + 1).alias("i")))
    near = F.array_min(dist)["i"]

    def pick(c):
        lo, hi = F.greatest(c - width, F.lit(1)), F.least(c + width, F.size(levels))
        items = F.transform(F.sequence(lo, hi), lambda i: F.struct(
            F.element_at(F.col(levels), i).cast("double").alias("v"), (-i).alias("i")))
        return -F.array_max(F.filter(items, lambda x: _finite(x.v)))["i"]
    return let(near, pick)


def level_features(spectra: DataFrame, keep: Sequence[str], freqs: str, levels: str, wanted: Sequence[float]) -> DataFrame:
    """Level and prominence at each requested frequency, from the strongest bin within two."""
    pr = spectra.withColumn("__pr", prominence(freqs, levels))
    rows = F.array(*[F.struct(F.lit(float(h)).alias("hz"), strongest_near(freqs, levels, h).alias("bin")) for h in wanted])
    d = pr.select(*keep, freqs, levels, "__pr", F.explode(rows).alias("w"))
    return d.select(*keep, "w.hz", (F.col("w.bin") - 1).alias("bin"), F.element_at(levels, F.col("w.bin")).cast("double")
                    .alias("level_db"), F.element_at("__pr", F.col("w.bin")).alias("prominence_db"))


def whole_hours(samples: DataFrame, keys: Sequence[str], pos: str, value: str, expected: int, slack: int = 0) -> DataFrame:
    """Traces of whole hours, as arrays in order. An hour with a gap inside is dropped, not padded.

    Recorders start and end a few samples off the hour: up to ``slack`` samples (a second's worth) may be missing at the
    edges, and as many too many are cut off at the end. A position that comes twice is a gap in the clock: such an hour is dropped.
    One channel-hour is rate times 3600 samples, which bounds the array.
    """
    g = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.countDistinct(pos).alias("__d"), F.min(pos).alias("__lo"), F.max(pos).alias("__hi"),
        F.sort_array(F.collect_list(F.struct(pos, value))).alias("__s"))
    whole = (F.col("__n") == F.col("__d")) & (F.col("__hi") - F.col("__lo") + 1 == F.col("__d")) & F.col("__d").between(
        expected - slack, expected + slack)
    return g.where(whole).select(*keys, F.transform(F.slice("__s", 1, expected), lambda s: s[value].cast("double")).alias("trace"))


def _segments(x: np.ndarray, seg: int, detrend: str) -> np.ndarray:
    starts = range(0, len(x) - seg + 1, seg - seg // 2)
    s = np.stack([x[a:a + seg] for a in starts])
    if detrend == "linear":
        t = np.arange(seg) - (seg - 1) / 2
        s = s - s.mean(axis=1, keepdims=True)
        s = s - np.outer(s @ t / (t @ t), t)
    else:
        s = s - s.mean(axis=1, keepdims=True)
    return s


def _welch(x: np.ndarray, y: np.ndarray | None, rate: float, seg: int, detrend: str):
    """One-sided averaged (cross) spectrum with a periodic Hann taper and half overlap."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    fx = np.fft.rfft(_segments(x, seg, detrend) * w, axis=1)
    fy = fx if y is None else np.fft.rfft(_segments(y, seg, detrend) * w, axis=1)
    p = (np.conj(fx) * fy).mean(axis=0) / (rate * (w @ w))
    p[1:(seg + 1) // 2] *= 2
    return p


def welch_spectra(traces: DataFrame, keep: Sequence[str], rate: float, seg: int) -> DataFrame:
    """Power spectrum in dB per whole hour (numpy inside Arrow batches), with its frequencies."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        with np.errstate(divide="ignore"):
            return s.map(lambda v: (10 * np.log10(_welch(np.asarray(v, float), None, rate, seg, "linear").real)).tolist())
    freqs = F.transform(F.sequence(F.lit(0), F.lit(seg // 2)), lambda k: k * (rate / seg))
    return traces.select(*keep, freqs.alias("freqs"), run("trace").alias("levels"))


def pooled_coherence(pairs: DataFrame, keys: Sequence[str], x: str, y: str, rate: float, seg: int) -> DataFrame:
    """Coherence per bin from cross and power spectra summed over hours; the sums are a plain group by."""
    out = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("xx", "yy", "re", "im")]))

    @F.pandas_udf(out)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(u, v):
            n = min(len(u), len(v))
            u, v = np.asarray(u, float)[:n], np.asarray(v, float)[:n]
            xx, yy = (_welch(z, None, rate, seg, "constant").real for z in (u, v))
            xy = _welch(u, v, rate, seg, "constant")
            return [dict(xx=float(p), yy=float(q), re=float(c.real), im=float(c.imag)) for p, q, c in zip(xx, yy, xy)]
        return pd.Series([one(u, v) for u, v in zip(a, b)])
    d = pairs.select(*keys, F.posexplode(run(x, y)).alias("bin", "s"))
    g = d.groupBy(*keys, "bin").agg(*[F.sum(f"s.{c}").alias(c) for c in ("xx", "yy", "re", "im")],
                                    F.count(F.lit(1)).alias("hours"))
    coh = F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.nullif(F.col("xx") * F.col("yy"), F.lit(0.0)))
    return g.select(*keys, "bin", (F.col("bin") * (rate / seg)).alias("hz"), coh.alias("coherence"), "hours")


def median_spectrum(spectra: DataFrame, keys: Sequence[str], freqs: str, levels: str) -> DataFrame:
    """Median level per bin and group, gathered back to one spectrum (bins bound the array)."""
    d = spectra.select(*keys, F.posexplode(F.arrays_zip(F.col(freqs).alias("f"), F.col(levels).alias("v"))).alias("bin", "z"))
    d = d.select(*keys, "bin", F.col("z.f").cast("double").alias("f"), F.col("z.v").cast("double").alias("v"))
    d = d.where(_finite(F.col("v")))
    m = exact_quantiles(d, [*keys, "bin", "f"], "v", [0.5], ["m"])
    return m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "f", "m"))).alias("s")).select(
        *keys, F.transform("s", lambda x: x.f).alias("freqs"), F.transform("s", lambda x: x.m).alias("levels"))


def compare_spectra(before: DataFrame, after: DataFrame, freqs: str, levels: str, band: tuple[float, float],
                    min_prominence: float, min_change: float, same_instrument: bool = True,
                    allow_change: bool = False) -> DataFrame:
    """Peaks of the after period that the before period lacks, with change and persistence.

    An instrument change is refused unless allowed, and then every row carries it as a flag.
    """
    if not same_instrument and not allow_change:
        raise ValueError("instrument or location differs between the periods; allow_change compares anyway")
    mb, ma = (median_spectrum(x, [], freqs, levels) for x in (before, after))
    old = peaks(mb, [], "freqs", "levels", band, min_prominence / 2).select(F.col("i").alias("__j"))
    new = peaks(ma, [], "freqs", "levels", band, min_prominence)
    base = mb.select(F.posexplode("levels").alias("i", "before_db"))
    near = old.select(F.explode(F.sequence(F.col("__j") - 2, F.col("__j") + 2)).alias("i")).distinct()
    d = new.join(base, "i").withColumn("change_db", F.col("db") - F.col("before_db"))
    d = d.join(near, "i", "left_anti").where(F.col("change_db") >= min_change)
    pr = after.select(F.posexplode(prominence(freqs, levels)).alias("i", "p")).where(F.col("p").isNotNull())
    per = pr.groupBy("i").agg(F.avg((F.col("p") >= min_prominence / 2).cast("int")).alias("persistence"))
    return d.join(per, "i", "left").select(
        "hz", F.col("db").alias("after_db"), "before_db", "change_db", "prominence_db", "persistence",
        (F.col("persistence") >= 0.5).alias("persistent"), F.lit(not same_instrument).alias("instrument_changed"))


def trigger_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, short: int,
                  long: int) -> DataFrame:
    """Short-term over long-term average of the last rows; null until the long window is full. ``pos`` numbers the rows.

    Running sums are met with the sums ``short`` and ``long`` rows back by position, so no window spans a whole key.
    """
    d = df.withColumn("__one", F.lit(1).cast("long"))
    d = running(d, keys, order, None, {"__p": ("sum", "__one"), "__s": ("sum", value)}).drop("__one")
    back = d.select(*keys, F.col("__p").alias("__q"), F.col("__s").alias("__b"))

    def lagged(base, rows, name):
        b = back.select(*keys, (F.col("__q") + rows).alias("__p"), F.col("__b").alias(name))
        return base.join(b, [*keys, "__p"], "left")
    d = lagged(lagged(d, short, "__bs"), long, "__bl")
    sta = (F.col("__s") - F.coalesce("__bs", F.lit(0.0))) / short
    lta = (F.col("__s") - F.coalesce("__bl", F.lit(0.0))) / long
    ratio = F.when(F.col("__p") >= long, F.try_divide(sta, F.nullif(lta, F.lit(0.0))))
    return d.withColumn("ratio", ratio).withColumnRenamed("__p", "pos").drop("__s", "__bs", "__bl")


def one_sided_hours(cells: DataFrame, keys: Sequence[str], hour: str, km: str, bearing: str, radius_km: float,
                    max_spread: float, per_day: int) -> DataFrame:
    """Hours whose strong cells within twice the radius lie in one arc, three or more of them 3 km to the radius off.

    At most ``per_day`` hours a day, those with most cells first (ties: nearer).
    """
    from fieldbook.operators.rollups import direction_spread
    d = cells.where(F.col(km) <= 2 * radius_km)
    near = F.col(km).between(3.0, radius_km)
    a = F.radians(bearing)
    g = d.groupBy(*keys, hour).agg(
        F.count_if(near).alias("cells"), F.count_if(F.col(km) < 3).alias("__close"),
        F.pmod(F.degrees(F.atan2(F.avg(F.when(near, F.sin(a))), F.avg(F.when(near, F.cos(a))))) + 360, F.lit(360.0)).alias("truth_deg"))
    med = exact_quantiles(d.where(near), [*keys, hour], km, [0.5], ["median_km"], upper=True).drop("n")
    sp = direction_spread(d, [*keys, hour], bearing).select(*keys, hour, F.col("spread").alias("spread_deg"))
    j = g.where((F.col("cells") >= 3) & (F.col("__close") == 0)).join(sp, [*keys, hour]).where(
        F.col("spread_deg") <= max_spread).join(med, [*keys, hour])
    w = Window.partitionBy(*keys, F.to_date(hour)).orderBy(F.col("cells").desc(), "median_km", hour)
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_day).drop("__close")


def validation_score(events: DataFrame, axis: str, truth: str, within: float = 20.0, need: int = 3) -> DataFrame:
    """Events scored, axial hits within ``within`` degrees, and whether the pre-declared rule passes."""
    from fieldbook.functions import geo
    err = F.least(geo.angle_difference(axis, truth), geo.angle_difference(F.col(axis) + 180, F.col(truth)))
    d = events.where(F.col(axis).isNotNull()).withColumn("__e", err)
    hit = F.col("__e") <= within
    toward = geo.angle_difference(axis, truth) <= 90
    g = d.agg(F.count(F.lit(1)).alias("scored"), F.count_if(hit).alias("hits"), F.count_if(hit & toward).alias("toward"))
    one_way = (F.col("toward") == 0) | (F.col("toward") == F.col("hits"))
    return g.withColumn("passes", (F.col("hits") >= need) & one_way & (F.col("hits") * 2 >= F.col("scored")))


def window_notes(before: DataFrame, after: DataFrame, keys: Sequence[str], hour: str, expected: tuple[int, int],
                 least_share: float = 0.5) -> DataFrame:
    """Whether two windows may be compared, per key: calendar months that both hold (levels are seasonal), whole hours of
    each, and a flag where fewer than ``least_share`` of the ``expected`` hours carry a window's median."""
    def one(df, side):
        return df.select(*keys, F.date_trunc("hour", hour).alias("__h"), F.lit(side).alias("__s")).distinct()
    both = one(before, 0).unionByName(one(after, 1)).groupBy(*keys, F.month("__h").alias("__m")).agg(
        *[F.count_if(F.col("__s") == s).alias(f"__n{s}") for s in (0, 1)])
    out = both.groupBy(*keys).agg(F.sum("__n0").alias("hours_before"), F.sum("__n1").alias("hours_after"),
                                  F.count_if((F.col("__n0") > 0) & (F.col("__n1") > 0)).alias("shared_months"))
    return out.withColumns({"no_shared_month": F.col("shared_months") == 0,
                            "thin_before": F.col("hours_before") < expected[0] * least_share,
                            "thin_after": F.col("hours_after") < expected[1] * least_share})
