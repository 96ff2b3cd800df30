"""Intervals, runs, as-of joins, event proximity. Keys may be hot: windows run per ordered chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.plans.ordered import add_chunks, running, with_previous
from fieldbook.plans.skew import salted_join


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """Half-open intervals merged per key; touching ones join when ``touching``. Null end means open.

    The running greatest end is carried chunk by chunk, so a key with a third of all intervals is many tasks.
    """
    far = F.lit("9999-12-31").cast("date")
    d = df.select(*keys, start, F.coalesce(F.col(end), far).alias("__e")).groupBy(*keys, start).agg(
        F.max("__e").alias("__e"))
    d, ch = add_chunks(d, keys, start), F.col("__ck")
    d = running(d, keys, [start], ch, {"__reach": ("max", "__e")}, inclusive=False)
    gap = (F.col(start) > F.col("__reach")) if touching else (F.col(start) >= F.col("__reach"))
    d = d.withColumn("__new", F.when(F.col("__reach").isNull() | gap, 1).otherwise(0).cast("long"))
    d = running(d, keys, [start], ch, {"__island": ("sum", "__new")})
    out = d.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max("__e").alias(end)).drop("__island")
    return out.withColumn(end, F.when(F.col(end) < far, F.col(end)))


def tiled(windows: DataFrame, spans: DataFrame, keys: Sequence[str], win: tuple[str, str],
          span: tuple[str, str]) -> DataFrame:
    """Whether complete spans (inclusive days) cover every day of each window (inclusive days)."""
    s = spans.select(*keys, F.col(span[0]).alias("__s"), F.date_add(span[1], 1).alias("__e"))
    merged = merge_intervals(s, keys, "__s", "__e").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], "__s", "__e")
    # the only candidate is the last merged span that starts on or before the window: an as-of lookup by year bucket
    return _covering(windows, merged, keys, win)


def _covering(windows, merged, keys, win):
    marks = merged.select(*[F.col(f"__k_{k}").alias(k) for k in keys], F.col("__s").alias("__t"),
                          F.lit(0).alias("__kind"), F.struct("__s", "__e").alias("__span"),
                          F.lit(None).cast("date").alias("__w0"), F.lit(None).cast("date").alias("__w1"))
    asks = windows.select(*keys, F.col(win[0]).alias("__t"), F.lit(1).alias("__kind"),
                          F.lit(None).cast("struct<__s:date,__e:date>").alias("__span"),
                          F.col(win[0]).alias("__w0"), F.col(win[1]).alias("__w1")).distinct()
    u = marks.unionByName(asks)
    u = running(u, keys, ["__t", "__kind", "__w1"], None, {"__last": ("last", "__span")})
    got = u.where("__kind = 1").select(
        *keys, F.col("__w0").alias(win[0]), F.col("__w1").alias(win[1]),
        F.coalesce(F.col("__last.__e") > F.col("__w1"), F.lit(False)).alias("covered"))
    return windows.join(got, [*keys, *win], "left")


def year_runs(df: DataFrame, keys: Sequence[str], year: str, out: str = "years", sep: str = ", ") -> DataFrame:
    """Consecutive years to text, ``1990-1992, 1995``. Distinct years per key are few by nature (calendar years)."""
    w = Window.partitionBy(*keys).orderBy(year)
    d = df.select(*keys, F.col(year).cast("int").alias(year)).distinct()
    d = d.withColumn("__r", F.col(year) - F.row_number().over(w))
    runs = d.groupBy(*keys, "__r").agg(F.min(year).alias("a"), F.max(year).alias("b"))
    label = lambda r: F.when(r.a == r.b, r.a.cast("string")).otherwise(F.concat(r.a, F.lit("-"), r.b))
    return (runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("__rs"))
            .select(*keys, F.array_join(F.transform("__rs", label), sep).alias(out)))


def value_drift(df: DataFrame, keys: Sequence[str], value: str, year: str) -> DataFrame:
    """Distinct values of a field and the years each held."""
    return year_runs(df.select(*keys, value, year), [*keys, value], year, sep=",")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: str) -> DataFrame:
    """Keep a version only when its content differs from the version right before it."""
    d = df.withColumn("__digest", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    d = with_previous(d, keys, order, ["__digest"], None, "__p")
    return d.where(F.col("__p").isNull() | (F.col("__p.__digest") != F.col("__digest"))).drop("__p", "__digest")


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """On/off transitions and partial hours: ``event`` is START-UP, SHUTDOWN or null, ``partial`` 0 < amount < 1."""
    d = df.withColumn("on", F.coalesce(F.col(amount), F.lit(0.0)) > 0)
    d = with_previous(d, keys, order, ["on"], None, "__p")
    changed = F.col("__p").isNotNull() & (F.col("__p.on") != F.col("on"))
    return d.withColumn("event", F.when(changed & F.col("on"), "START-UP").when(changed, "SHUTDOWN")).withColumn(
        "partial", F.col("on") & (F.col(amount) < 1)).drop("__p")


def change_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 fields: Sequence[str]) -> DataFrame:
    """Which fields differ from the epoch before (``changed`` lists them; empty text for none)."""
    d = with_previous(df, keys, order, fields, None, "__p")
    parts = [F.when(F.col("__p").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__p.{c}")), F.lit(c)) for c in fields]
    return d.withColumn("changed", F.concat_ws(",", *parts)).drop("__p")


def nearest_year(left: DataFrame, right: DataFrame, keys: Sequence[str], want: str, year: str, carry: Sequence[str],
                 max_gap: int | None = None) -> DataFrame:
    """For each left row the right year equal or nearest to the wanted one; ties go to the earlier year.

    One candidate per (key, year) is enough, so the right side is reduced to it before the join.
    """
    item = F.struct(F.col(year).alias(year), *carry)
    r = right.groupBy(*keys, year).agg(*[F.min(c).alias(c) for c in carry])
    asks = left.select(*keys, want).distinct()
    j = asks.join(r, list(keys))
    gap = F.abs(F.col(year) - F.col(want))
    best = j.groupBy(*keys, want).agg(F.min_by(item, F.struct(gap, (F.col(year) > F.col(want)).cast("int"))).alias("b"))
    out = left.join(best, [*keys, want], "left")
    ok = F.lit(True) if max_gap is None else F.abs(F.col(f"b.{year}") - F.col(want)) <= max_gap
    return out.select(*left.columns, *[F.when(ok, F.col(f"b.{c}")).alias(c) for c in (year, *carry)])


def hour_join(series: DataFrame, hourly: DataFrame, ts: str, hour: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equi join of a feature series to an hourly table on the hour bucket."""
    return series.withColumn(hour, F.date_trunc("hour", ts)).join(hourly, [*keys, hour])


def _buckets(start: Column, end: Column, days: int) -> Column:
    epoch = F.lit("1970-01-01").cast("date")
    lo = F.floor(F.datediff(start, epoch) / days)
    hi = F.floor(F.datediff(end, epoch) / days)
    return F.sequence(lo, F.greatest(lo, hi))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_span: tuple[str, str],
                 r_span: tuple[str, str], salt_by: Sequence[str], days: int = 180) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap; null end is open.

    Both sides are cut into day buckets and met by an equi join on (key, bucket), so no key's rows are all compared
    with each other, and a hot (key, bucket) is split. A pair is kept only in the first bucket both touch. An open end
    reaches to the last start on the other side, beyond which it can meet nothing.
    """
    far, epoch = F.lit("9999-12-31").cast("date"), F.lit("1970-01-01").cast("date")

    def cut(df, span, other, other_span):
        last = other.agg(F.date_add(F.max(other_span[0]), 1).alias("m")).select("m").scalar()
        end = F.date_sub(F.greatest(F.least(F.coalesce(F.col(span[1]), far), last), F.date_add(span[0], 1)), 1)
        return df.withColumn("__b", F.explode(_buckets(F.col(span[0]), end, days)))
    j = salted_join(cut(left, l_span, right, r_span), cut(right, r_span, left, l_span), [*keys, "__b"], salt_by)
    first = F.floor(F.datediff(F.greatest(F.col(l_span[0]), F.col(r_span[0])), epoch) / days)
    return j.where((F.col(l_span[0]) < F.coalesce(F.col(r_span[1]), far))
                   & (F.col(r_span[0]) < F.coalesce(F.col(l_span[1]), far)) & (F.col("__b") == first)).drop("__b")


def within_days(left: DataFrame, right: DataFrame, keys: Sequence[str], l_date: str, r_date: str, before: int,
                after: int) -> DataFrame:
    """Pairs with r_date in [l_date - before, l_date + after]; day buckets as wide as the window."""
    width = max(1, before + after)
    epoch = F.lit("1970-01-01").cast("date")
    b = lambda c: F.floor(F.datediff(c, epoch) / width)
    r = right.withColumn("__b", b(F.col(r_date)))
    l = left.withColumn("__b", F.explode(F.sequence(b(F.date_sub(l_date, before)), b(F.date_add(l_date, after)))))
    return salted_join(r, l, [*keys, "__b"], [r_date, *keys]).where(
        F.col(r_date).between(F.date_sub(l_date, before), F.date_add(l_date, after))).drop("__b")


def peak_after(events: DataFrame, readings: DataFrame, keys: Sequence[str], event_id: str, event_ts: str, reading_ts: str,
               value: str, carry: Sequence[str], most_s: int) -> DataFrame:
    """Each event with the highest reading of its key up to ``most_s`` seconds later: readings, peak, lag_s of the peak (the
    first of equals) and ``carry`` of that reading. An event that no reading follows keeps nulls and 0 readings.

    No pairs are formed. Time is cut in slices of ``most_s``, so what follows an event is the rest of its own slice and the
    beginning of the next: two running maxima over the readings of a slice, one from its end, one from its beginning.
    """
    micros = most_s * 1_000_000
    at = lambda c: F.floor(F.unix_micros(c) / micros)
    known = readings.where(F.col(value).isNotNull() & F.col(reading_ts).isNotNull())
    best = F.struct(F.col(value).alias("peak"), (-F.unix_micros(reading_ts)).alias("at"), *carry)
    kind = known.select(best.alias("b")).schema["b"].dataType
    asks = events.where(F.col(event_ts).isNotNull())
    for k in keys:
        known, asks = known.where(F.col(k).isNotNull()), asks.where(F.col(k).isNotNull())
    got = None
    # readings before asks where both fall on one moment: both ends of the reach count
    for slice_, moment, mark in ((at(event_ts), F.unix_micros(event_ts), -1), (at(event_ts) + 1, F.unix_micros(event_ts) + micros, 1)):
        r = known.select(*keys, at(reading_ts).alias("__b"), (mark * F.unix_micros(reading_ts)).alias("__t"), F.lit(0).alias("__ask"),
                         F.lit(1).cast("long").alias("__one"), best.alias("__best"), F.lit(None).cast(dict(events.dtypes)[event_id]).alias("__id"),
                         F.lit(None).cast("long").alias("__from"))
        a = asks.select(*keys, slice_.alias("__b"), (mark * moment).alias("__t"), F.lit(1).alias("__ask"), F.lit(0).cast("long").alias("__one"),
                        F.lit(None).cast(kind).alias("__best"), F.col(event_id).alias("__id"), F.unix_micros(event_ts).alias("__from"))
        u = running(r.unionByName(a), [*keys, "__b"], ["__t", "__ask"], None, {"__n": ("sum", "__one"), "__p": ("max", "__best")})
        u = u.where("__ask = 1").select("__id", "__from", "__n", "__p")
        got = u if got is None else got.unionByName(u)
    lag = (-F.col("__p.at") - F.col("__from")) / 1_000_000
    top = F.max(F.when(F.col("__p").isNotNull(), F.struct("__p.peak", (-lag).alias("__l"), *[F.col(f"__p.{c}") for c in carry])))
    got = got.groupBy(F.col("__id").alias(event_id)).agg(F.sum("__n").alias("readings"), top.alias("__p"))
    return events.join(got, event_id, "left").select(
        *events.columns, F.coalesce("readings", F.lit(0)).alias("readings"), "__p.peak", (-F.col("__p.__l")).alias("lag_s"),
        *[f"__p.{c}" for c in carry])


def certificate_as_of(samples: DataFrame, certs: DataFrame, keys: Sequence[str], sample_id: str, sample_date: str,
                      cert_date: str, cert_id: str, label: str, before: int = 60, after: int = 45) -> DataFrame:
    """The certificate that covers a sample: a fiscal-year label match wins, else the issue-date window.

    ``label`` is a column on both sides (samples carry their own fiscal label). Newest certificate wins in a class.
    """
    c = certs.select(*keys, F.col(cert_id), F.col(cert_date), F.col(label).alias("__cl"))
    rank = lambda how: F.struct(F.lit(how).alias("how"), F.col(cert_date).alias("date"), F.col(cert_id).alias("id"))
    by_label = (samples.select(*keys, sample_id, F.col(label).alias("__cl"))
                .join(c.groupBy(*keys, "__cl").agg(F.max(rank(1)).alias("h")), [*keys, "__cl"])
                .select(sample_id, "h"))
    win = within_days(samples.select(*keys, sample_id, sample_date), c, keys, sample_date, cert_date, before, after)
    by_win = win.groupBy(sample_id).agg(F.max(rank(0)).alias("h"))
    best = by_label.unionByName(by_win).groupBy(sample_id).agg(F.max("h").alias("h"))
    return samples.join(best, sample_id, "left").select(
        *samples.columns, F.col("h.id").alias(cert_id), F.col("h.date").alias(cert_date),
        F.when(F.col("h.how") == 1, "fiscal year label").when(F.col("h.how") == 0, "date window").otherwise("none")
        .alias("certificate_by"))


def documents_between(found: DataFrame, docs: DataFrame, keys: Sequence[str], sample_id: str, lo: str, hi: str,
                      doc_date: str, doc_class: str, classes: Sequence[str]) -> DataFrame:
    """Counts of documents of each class dated after ``lo`` and up to ``hi`` for each sample.

    Cumulative counts per key make this two as-of lookups instead of a pair per document.
    """
    day = docs.groupBy(*keys, F.to_date(doc_date).alias("__t")).agg(
        *[F.count_if(F.col(doc_class) == c).alias(f"__n_{i}") for i, c in enumerate(classes)])
    cums = {f"__c_{i}": ("sum", f"__n_{i}") for i in range(len(classes))}
    nulls = [F.lit(0).cast("long").alias(f"__n_{i}") for i in range(len(classes))]
    marks = day.select(*keys, "__t", F.lit(0).alias("__kind"), F.lit(None).cast("string").alias("__id"),
                       *[f"__n_{i}" for i in range(len(classes))])
    asks = None
    for kind, col in ((1, lo), (2, hi)):
        a = found.where(F.col(lo).isNotNull()).select(
            *keys, F.to_date(col).alias("__t"), F.lit(kind).alias("__kind"),
            F.col(sample_id).cast("string").alias("__id"), *nulls)
        asks = a if asks is None else asks.unionByName(a)
    u = running(marks.unionByName(asks), keys, ["__t", "__kind", "__id"], None, cums)
    got = u.where("__kind > 0").groupBy("__id").agg(*[
        (F.max(F.when(F.col("__kind") == 2, F.col(f"__c_{i}"))) - F.max(F.when(F.col("__kind") == 1, F.col(f"__c_{i}"))))
        .alias(f"n_{c}") for i, c in enumerate(classes)])
    return (found.join(got, found[sample_id].cast("string") == got["__id"], "left").drop("__id")
            .na.fill(0, [f"n_{c}" for c in classes]))


def explained_by_event(visits: DataFrame, events: DataFrame, keys: Sequence[str], visit_id: str, visit_date: str,
                       event_date: str, days: int = 3) -> DataFrame:
    """Visits with the number of events within ``days`` either side; none means UNEXPLAINED."""
    daily = events.groupBy(*keys, F.col(event_date).alias("__ed")).agg(F.count(F.lit(1)).alias("__n"))
    near = within_days(visits.select(*keys, visit_id, visit_date), daily, keys, visit_date, "__ed", days, days)
    n = near.groupBy(visit_id).agg(F.sum("__n").alias("events"))
    return visits.join(n, visit_id, "left").na.fill(0, ["events"]).withColumn(
        "class", F.when(F.col("events") > 0, "EXPLAINED").otherwise("UNEXPLAINED"))


def fill_between(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                 out: str = "filled") -> DataFrame:
    """Missing values between two known ones by even spacing; at the ends they run up to one unit outward."""
    chunk = F.col("__ck")
    d = add_chunks(df, keys, order[0]).withColumn("__one", F.lit(1).cast("long"))
    d = running(d, keys, order, chunk, {"__pos": ("sum", "__one")}).drop("__one")
    d = d.withColumn("__known", F.when(F.col(value).isNotNull(), F.struct(
        F.col("__pos").alias("p"), F.col(value).cast("double").alias("v"))))
    d = running(d, keys, order, chunk, {"__lo": ("last", "__known"), "__hi": ("first_next", "__known")})
    total = d.groupBy(*keys).agg(F.max("__pos").alias("__n")) if keys else None
    if total is not None:
        d = d.join(total, list(keys))
    else:
        d = d.withColumn("__n", d.agg(F.max("__pos").alias("m")).select("m").scalar())
    lo, hi, p = F.col("__lo"), F.col("__hi"), F.col("__pos")
    lo_p, lo_v = F.coalesce(lo["p"], F.lit(0)), F.coalesce(lo["v"], hi["v"] - 1.0)
    hi_p, hi_v = F.coalesce(hi["p"], F.col("__n") + 1), F.coalesce(hi["v"], lo["v"] + 1.0)
    est = lo_v + (hi_v - lo_v) * (p - lo_p) / (hi_p - lo_p)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(est)).drop(
        "__pos", "__known", "__lo", "__hi", "__n", "__ck")


def level_interpolation(heights: DataFrame, levels: DataFrame, keys: Sequence[str], z: str, level_z: str,
                        fields: Sequence[str], max_gap: float) -> DataFrame:
    """Values at a height from the bracketing levels, refused (null) when they are too far apart.

    One as-of pass down and one up over the union of levels and wanted heights; hot profiles are cut into chunks.
    """
    item = F.struct(F.col(level_z).alias("z"), *fields)
    lv = levels.select(*keys, F.col(level_z).alias("__z"), F.lit(0).alias("__kind"), item.alias("__lv"))
    ask = heights.select(*keys, F.col(z).alias("__z"), F.lit(1).alias("__kind")).distinct().withColumn(
        "__lv", F.lit(None).cast(lv.schema["__lv"].dataType))
    u = lv.withColumn("__k2", F.lit(0)).unionByName(ask.withColumn("__k2", F.lit(1)))
    u, ch = add_chunks(u, keys, "__z"), F.col("__ck")
    u = running(u, keys, ["__z", "__k2"], ch, {"__b": ("last", "__lv")})
    u = running(u, keys, [F.col("__z"), -F.col("__k2")], ch, {"__a": ("first_next", "__lv")})
    g = u.where("__kind = 1")
    b, a = F.col("__b"), F.col("__a")
    span = a["z"] - b["z"]
    exact = (a["z"] == F.col("__z")) | (b["z"] == F.col("__z"))
    ok = a.isNotNull() & b.isNotNull() & ((span <= max_gap) | exact)
    f = F.when(span == 0, 0.0).otherwise((F.col("__z") - b["z"]) / F.nullif(span, F.lit(0.0)))
    return g.select(*keys, F.col("__z").alias(z), *[F.when(ok, b[c] + f * (a[c] - b[c])).alias(c) for c in fields])


def trigger_sessions(df: DataFrame, keys: Sequence[str], order: str, ratio: str, on: float, off: float) -> DataFrame:
    """Sessions that open when the ratio reaches ``on`` and close when it falls below ``off``.

    Between the two thresholds the state is whatever it was, so it is a forward fill of the last decisive row.
    """
    r = F.col(ratio)
    chunk = F.col("__ck")
    d = add_chunks(df, keys, order).withColumn("__mark", F.when(r >= on, 1).when(r < off, 0).cast("long"))
    d = running(d, keys, [order], chunk, {"__state": ("last", "__mark")})
    d = d.withColumn("__state", F.coalesce("__state", F.lit(0)))
    d = with_previous(d, keys, [order], ["__state"], chunk, "__p")
    d = d.withColumn("__open", ((F.col("__state") == 1) & (F.coalesce(F.col("__p.__state"), F.lit(0)) == 0))
                     .cast("long"))
    d = running(d, keys, [order], chunk, {"session": ("sum", "__open")})
    return (d.where("__state = 1").groupBy(*keys, "session")
            .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.max(ratio).alias("peak"),
                 F.count(F.lit(1)).alias("rows")))



def refraction(levels: DataFrame, keys: Sequence[str], z: str, speed: str, top: float) -> DataFrame:
    """Change of the effective speed of sound from the lowest level to the one nearest ``top`` above ground, and what it
    does to sound: it bends down into a duct where speed grows with height. Without a level above ground both are null."""
    up = F.struct(F.abs(F.col(z) - top), z)
    g = levels.groupBy(*keys).agg(F.min(z).alias("low_z"), F.min_by(speed, z).alias("__s"),
                                  F.min_by(F.struct(F.col(z).alias("z"), F.col(speed).alias("s")), F.when(F.col(z) > 0, up)).alias("__t"))
    delta = F.col("__t.s") - F.col("__s")
    return g.select(*keys, "low_z", F.col("__t.z").alias("top_z"), delta.alias("delta"),
                    F.when(delta > 0, "downward").when(delta.isNotNull(), "upward").alias("refraction"))
