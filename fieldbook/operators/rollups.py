"""Null-careful aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.plans.skew import salted_join


def radius_rollup(facts: DataFrame, places: DataFrame, center: tuple[float, float], radius_mi: float, fact_key: str,
                  place_key: str, name: str, item: str, by: str) -> DataFrame:
    """Totals of everything within a radius of a point, per facility or per item.

    The radius is applied to the places (a box of plain numbers first, then the exact distance), so the facts are
    met by one join on the survivors. Short forms disclose no quantity and are only counted; grams stay apart from
    pounds. ``facts`` has columns onsite, air, short_form, grams, flagged.
    """
    s, n, w, e = geo.degree_box(*center, radius_mi)
    near = (places.where(F.col("lat").between(s, n) & F.col("lon").between(w, e))
            .withColumn("__d", geo.haversine(center[0], center[1], "lat", "lon")).where(F.col("__d") <= radius_mi)
            .select(F.col(place_key).alias(fact_key), F.col(name).alias("name"), "__d"))
    # only keys and numbers pass the aggregation, so it stays hash based; names come back at the end
    j = facts.join(near.select(fact_key), fact_key)
    lb = ~F.col("short_form") & ~F.col("grams")
    g = ~F.col("short_form") & F.col("grams")
    # facility x item first: one hot facility is combined before its items are counted
    part = j.groupBy(fact_key, item).agg(
        F.sum(F.when(lb, F.col("onsite"))).alias("lb"), F.sum(F.when(lb, F.col("air"))).alias("air"),
        F.sum(F.when(lb & F.col("flagged"), F.col("onsite"))).alias("fl"), F.sum(F.when(g, F.col("onsite"))).alias("g"),
        F.count_if(F.col("short_form")).alias("sf"), F.count_if(lb).alias("n_lb"),
        F.count_if(~F.col("grams")).alias("n_not_g"))
    z = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    if by == "facility":
        sums = part.groupBy(fact_key).agg(
            z("lb").alias("onsite_lb"), z("air").alias("air_lb"), z("fl").alias("flagged_lb"), z("g").alias("onsite_g"),
            F.sum("sf").alias("short_forms"), F.count_if(F.col("n_lb") > 0).alias("chemicals"))
        return sums.join(near, fact_key).select(
            fact_key, "name", F.round("__d", 6).alias("distance_mi"), "onsite_lb", "air_lb", "flagged_lb", "onsite_g",
            "short_forms", "chemicals")
    return (part.groupBy(item).agg(
        z("lb").alias("onsite_lb"), z("air").alias("air_lb"), z("g").alias("onsite_g"),
        F.count_if(F.col("n_lb") > 0).alias("facilities"), F.count_if(F.col("sf") > 0).alias("short_form_facilities"),
        F.sum("n_not_g").alias("__k"))
        .where((F.col("short_form_facilities") > 0) | (F.col("__k") > 0)).drop("__k"))


def direction_spread(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """Smallest arc that covers all directions of a key, and the axial (doubled-angle) strength.

    Directions are reduced to distinct values per key first; a key's distinct directions are bounded by the
    precision of the angle (0.01 degree gives 36,000).
    """
    a = F.col(angle)
    rad = F.radians(a * 2)
    axial = df.groupBy(*keys).agg(F.avg(F.sin(rad)).alias("__s"), F.avg(F.cos(rad)).alias("__c"),
                                  F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(a)
    gaps = (df.select(*keys, a).distinct()
            .withColumn("__gap", F.coalesce(F.lead(a).over(w) - a, F.first(a).over(w) + 360 - a))
            .groupBy(*keys).agg((F.lit(360.0) - F.max("__gap")).alias("spread")))
    return (gaps.join(axial, list(keys)).withColumn("axial_strength", F.hypot("__s", "__c"))
            .withColumn("axis", F.pmod(F.degrees(F.atan2("__s", "__c")) / 2, F.lit(180.0))).drop("__s", "__c"))


def layer_areas(points: DataFrame, a: str, b: str, area: float) -> DataFrame:
    """Union, intersection and difference of two layers over an even sample, as counts and areas."""
    n = F.count(F.lit(1))
    ca, cb = F.col(a), F.col(b)
    agg = points.agg(n.alias("points"), F.count_if(ca | cb).alias("either"), F.count_if(ca & cb).alias("both"),
                     F.count_if(ca & ~cb).alias("a_only"), F.count_if(cb & ~ca).alias("b_only"))
    return agg.withColumns({f"{c}_area": F.col(c) * area / F.col("points") for c in ("either", "both", "a_only",
                                                                                     "b_only")})


def point_status(points: DataFrame, near: DataFrame, key: str, distance: str) -> DataFrame:
    """Designated at the point, only nearby, or neither: three different answers."""
    c = near.groupBy(key).agg(F.count_if(F.col(distance) == 0).alias("at_point"),
                              F.count_if(F.col(distance) > 0).alias("nearby"))
    return (points.join(c, key, "left").na.fill(0, ["at_point", "nearby"])
            .withColumn("status", F.when(F.col("at_point") > 0, "designated").when(F.col("nearby") > 0, "nearby")
                        .otherwise("none")))


def facility_years(facts: DataFrame, facility: str, year: str, item: str, amount: str) -> DataFrame:
    """Per facility and year: amounts by medium and flag, grams apart, short forms and range midpoints counted.

    ``facts`` has columns air, short_form, grams, flagged beside the amount. Items are pre-summed per facility-year,
    so distinct counts need no second pass over the rows.
    """
    lb = ~F.col("short_form") & ~F.col("grams")
    a = F.col(amount)
    part = facts.groupBy(facility, year, item).agg(
        F.sum(F.when(lb, a)).alias("lb"), F.sum(F.when(lb, F.col("air"))).alias("air"),
        F.sum(F.when(lb & F.col("flagged"), a)).alias("fl"),
        F.sum(F.when(~F.col("short_form") & F.col("grams"), a)).alias("g"), F.count_if(lb).alias("n"),
        F.count_if(F.col("short_form")).alias("sf"), F.count_if(lb & a.isin(5.0, 250.0, 750.0)).alias("mid"))
    z = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return part.groupBy(facility, year).agg(
        z("lb").alias("total_lb"), z("air").alias("air_lb"), z("fl").alias("flagged_lb"), z("g").alias("total_g"),
        F.count_if(F.col("n") > 0).alias("n_items"), F.sum("n").alias("rows_lb"), F.sum("sf").alias("short_forms"),
        F.count_if(F.col("sf") > 0).alias("short_form_items"), F.sum("mid").alias("range_midpoint_rows"))


def reconcile(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str) -> DataFrame:
    """Stated total against the sum of its parts, as a verdict per key. A violation is a row, never an exception."""
    s = parts.groupBy(*keys).agg(F.sum(part).alias("parts_sum"), F.count(F.lit(1)).alias("parts"))
    j = totals.select(*keys, total).join(s, list(keys), "full_outer")
    t, p = F.col(total), F.col("parts_sum")
    tol = F.greatest(F.lit(0.01), F.abs(t) * 1e-6)
    verdict = (F.when(t.isNull(), "not stated").when(p.isNull(), "no parts found")
               .when(F.abs(p - t) <= tol, "match").when(p < t, "short").otherwise("exceeds"))
    return j.withColumn("verdict", verdict)


def merge_certifications(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str) -> DataFrame:
    """One row per key: certifications identical in every measure count once, different ones are summed.

    Identical rows are collapsed before anything is gathered; the names of one facility-year are a handful.
    """
    distinct = df.groupBy(*keys, *measures).agg(F.min(name).alias("__n1"), F.count(F.lit(1)).alias("__c"))
    g = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__kinds"), F.sum("__c").alias("certifications"),
        *[F.sum(F.col(m) * F.col("__c")).alias(f"__s_{m}") for m in measures],
        *[F.max(m).alias(f"__x_{m}") for m in measures])
    names = df.select(*keys, name).distinct().groupBy(*keys).agg(
        F.concat_ws(" + ", F.array_sort(F.collect_list(F.col(name).cast("string")))).alias("names"))
    once = F.col("__kinds") == 1
    return g.select(*keys, "certifications", (once & (F.col("certifications") > 1)).alias("duplicate"), *[
        F.when(once, F.col(f"__x_{m}")).otherwise(F.col(f"__s_{m}")).alias(m) for m in measures]).join(
        names, list(keys))


def dedupe_and_bucket(df: DataFrame, ident: Sequence[str], first_by: Sequence[str], group: Sequence[str],
                      bucket: Column, labels: Sequence[str], value: str, usable: Column) -> DataFrame:
    """Count each (program, id, year, pollutant) once, then sum per group into fixed buckets.

    Rows whose unit is not usable are set aside and counted, not converted. The kept row of an identity is the
    first in ``first_by`` order, found by a min over structs (combined map-side), not by a window.
    """
    other = [c for c in df.columns if c not in ident]
    first = df.groupBy(*ident).agg(F.min_by(F.struct(*other), F.struct(*first_by)).alias("__f"))
    d = first.select(*ident, "__f.*")
    d = d.withColumns({"__ok": usable, "__b": bucket})
    return d.groupBy(*group).agg(
        *[F.sum(F.when(F.col("__ok") & (F.col("__b") == b), F.col(value))).alias(b) for b in labels],
        F.count_if(~F.col("__ok")).alias("set_aside"))


def null_careful_sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    from fieldbook.functions.values import null_sum_status
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in null_sum_status(value).items()])


def fan_out_check(facts: DataFrame, other: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """One row: the sum before and after a join, so that a table that multiplies rows is caught, not summed.

    The after-join sum is computed from per-key counts; the multiplied rows are never made.
    """
    a = facts.groupBy(*on).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n"))
    b = other.groupBy(*on).agg(F.count(F.lit(1)).alias("__m"))
    j = a.join(b, list(on), "left").withColumn("__m", F.coalesce("__m", F.lit(0)))
    r = j.agg(F.sum("__n").alias("rows_before"), F.sum(F.col("__n") * F.col("__m")).alias("rows_after"),
              F.sum("__s").alias("sum_before"), F.sum(F.col("__s") * F.col("__m")).alias("sum_after"),
              F.max("__m").alias("widest"))
    return r.withColumn("fans_out", F.col("widest") > 1)


def tabulate(df: DataFrame, dims: Sequence[str], caps: dict[str, int] | None = None) -> DataFrame:
    """Several one-way counts in one pass: (dim, value, n), blanks named, the largest few where a cap is a report's.

    The explode is combined map-side, so the shuffle carries counts.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")),
                                                                F.lit("(blank)")).alias("value")) for c in dims])
    n = df.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"))
    if not caps:
        return n
    w = Window.partitionBy("dim").orderBy(F.col("n").desc(), "value")
    limit = F.lit(2 ** 31 - 1)
    for c, k in caps.items():
        limit = F.when(F.col("dim") == c, k).otherwise(limit)
    top = max(caps.values())
    uncapped = n.where(~F.col("dim").isin(*caps))
    ranked = n.where(F.col("dim").isin(*caps)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    return uncapped.unionByName(ranked.where(F.col("__r") <= limit).drop("__r"))


def distinct_sets(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct values of each column per key as sorted text. Meant for domains of codes (matrices, types)."""
    out = None
    for c in cols:
        g = (df.select(*keys, c).where(F.col(c).isNotNull()).distinct().groupBy(*keys)
             .agg(F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias(c)))
        out = g if out is None else out.join(g, list(keys), "full_outer")
    return out


def hourly_wind(obs: DataFrame, keys: Sequence[str], ts: str, direction: str, speed: str) -> DataFrame:
    """Vector-mean wind per hour from text cells (``M`` missing).

    Speed 0 is calm (a zero vector); wind without a direction is variable and adds nothing.
    """
    s, dr = F.col(speed).try_cast("double"), F.radians(F.col(direction).try_cast("double"))
    calm = s == 0
    u = F.when(calm, 0.0).otherwise(s * F.sin(dr))
    v = F.when(calm, 0.0).otherwise(s * F.cos(dr))
    d = obs.withColumns({"hour": F.date_trunc("hour", F.col(ts)), "__u": u, "__v": v}).where(
        s.isNotNull() & (calm | dr.isNotNull()))
    g = d.groupBy(*keys, "hour").agg(F.avg("__u").alias("__u"), F.avg("__v").alias("__v"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "hour", "n", F.hypot("__u", "__v").alias("speed"),
                    F.pmod(F.degrees(F.atan2("__u", "__v")) + 360, F.lit(360.0)).alias("from_deg"))


def circular_mean(df: DataFrame, keys: Sequence[str], angle: str, weight: str) -> DataFrame:
    """Weighted mean direction in degrees."""
    a, w = F.radians(angle), F.col(weight)
    return df.groupBy(*keys).agg(F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) + 360,
                                        F.lit(360.0)).alias("mean_deg"))


def peer_comparison(values: DataFrame, target: DataFrame, peers: DataFrame, site: str, item: str, value: str,
                    size: str | None = None) -> DataFrame:
    """Target value against the median of the peers that have one, per item; size-relative ratio too.

    ``target`` and ``peers`` hold site ids (and ``size``). Peers without a value are counted out, never taken as 0.
    """
    from fieldbook.plans.quantiles import exact_quantiles
    cols = [site] + ([size] if size else [])
    t = values.join(target.select(*cols), site).groupBy(item).agg(F.sum(value).alias("target"), *(
        [F.max(size).alias("__ts")] if size else []))
    p = values.join(peers.select(*cols), site)
    med = exact_quantiles(p, [item], value, [0.5], ["median"]).withColumnRenamed("n", "n_peers")
    out = t.join(med, item, "left").withColumn("ratio", F.try_divide("target", F.nullif(F.col("median"), F.lit(0.0))))
    if size:
        pi = p.where(F.col(size) > 0).withColumn("__i", F.col(value) / F.col(size))
        mi = exact_quantiles(pi, [item], "__i", [0.5], ["__mi"]).drop("n")
        out = out.join(mi, item, "left").withColumn("intensity_ratio", F.try_divide(
            F.try_divide("target", "__ts"), F.nullif(F.col("__mi"), F.lit(0.0)))).drop("__mi", "__ts")
    return out


def survey_peaks(counts: DataFrame, colony: str, year: str, species: str, nests: str) -> DataFrame:
    """Several survey dates in a year are not added: the largest count stands. Peak and peak year per species."""
    yearly = counts.groupBy(colony, year, species).agg(F.max(nests).alias(nests))
    pos = F.col(nests) > 0
    return yearly.groupBy(colony, species).agg(
        F.max(F.when(pos, F.col(nests))).alias("peak"),
        F.min_by(year, F.when(pos, F.struct((-F.col(nests)).alias("m"), F.col(year)))).alias("peak_year"),
        F.count_if(pos).alias("active_years"), F.count(F.lit(1)).alias("surveyed_years"),
        F.max(F.when(pos, F.col(year))).alias("latest_active"))


def presence_tally(df: DataFrame, keys: Sequence[str], present: Column, ident: str) -> DataFrame:
    """Tested and present counts; positives are listed by ``positives``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("tested"), F.count_if(present).alias("present"),
                                 F.min(F.when(present, F.col(ident))).alias("first_positive"))


def collected_span(inventory: DataFrame, item: str, year: str) -> DataFrame:
    """First and last year any facility reported an item: outside it a blank means not collected."""
    return inventory.groupBy(item).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def complete_through(inventory: DataFrame, ident: str, year: str, share: float = 0.9) -> DataFrame:
    """Facilities per year, whether the year holds at least ``share`` of the year before, and the latest such year."""
    n = inventory.groupBy(year).agg(F.countDistinct(ident).alias("facilities"))
    prev = n.select((F.col(year) + 1).alias(year), F.col("facilities").alias("__p"))
    d = n.join(prev, year, "left").withColumn("complete", F.col("__p").isNull() | (F.col("facilities") >= F.col("__p")
                                                                                    * share)).drop("__p")
    return d.withColumn("complete_through", d.agg(F.max(F.when(F.col("complete"), F.col(year))).alias("m"))
                        .select("m").scalar())


def status_grid(inventory: DataFrame, ident: str, item: str, year: str, value: str) -> DataFrame:
    """Each facility-year that filed, by item: reported, not reported, or not collected that year.

    Items are a code list: their spans travel as one small array, the grid is filings times items.
    """
    span = collected_span(inventory, item, year)
    arr = span.agg(F.collect_list(F.struct(item, "first_year", "last_year")).alias("s")).select("s").scalar()
    filed = inventory.select(ident, year).distinct().withColumn("__i", F.explode(arr)).select(ident, year, "__i.*")
    vals = inventory.groupBy(ident, year, item).agg(F.sum(value).alias(value))
    j = filed.join(vals, [ident, year, item], "left")
    status = (F.when(F.col(value).isNotNull(), "reported")
              .when(F.col(year).between(F.col("first_year"), F.col("last_year")), "not reported")
              .otherwise("not collected"))
    return j.withColumn("status", status).drop("first_year", "last_year")


def _plant_key(facs: DataFrame, ident: str, registry: str, aliases: DataFrame | None) -> DataFrame:
    """``facs`` with __k, the plant a record belongs to: its registry id or its alias's, else itself.

    Only records with an alias go through the joins that find it, so the others' missing alias is no join key.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    named = lambda reg, own: F.coalesce(F.concat(F.lit("r:"), reg), F.concat(F.lit("i:"), own.cast("string")))
    if aliases is None:
        return facs.withColumn("__k", named(blank(registry), F.col(ident)))
    a = aliases.select(F.col(aliases.columns[0]).alias(ident), F.col(aliases.columns[1]).alias("__canon"))
    plain = facs.join(a, ident, "left_anti").withColumn("__k", named(blank(registry), F.col(ident)))
    reg = facs.select(F.col(ident).alias("__canon"), F.col(registry).alias("__creg"))
    other = facs.join(a, ident).join(reg, "__canon", "left").withColumn("__k", named(blank("__creg"), F.col("__canon")))
    return plain.unionByName(other.drop("__canon", "__creg"))


def collapse_plants(facs: DataFrame, ident: str, registry: str, last_year: str, carry: Sequence[str],
                    aliases: DataFrame | None = None, years: str | None = None) -> DataFrame:
    """Records of one plant (alias or shared registry id) merged; the id with the newest report names it.

    A blank registry id never merges. ``aliases`` is (id, canonical id). With ``years``, an array of each record's report
    years, the plant gets the sorted union of its records' years: a plant and year is one row before
    they are listed, so the list is as long as the calendar whatever the plant.
    """
    d = _plant_key(facs, ident, registry, aliases)
    best = F.max_by(F.struct(ident, *carry), F.struct(last_year, ident)).alias("__b")
    out = d.groupBy("__k").agg(best, F.count(F.lit(1)).alias("merged"), F.max(last_year).alias(last_year))
    if years:
        held = d.select("__k", F.explode(years).alias("__y")).distinct().groupBy("__k").agg(F.sort_array(F.collect_list("__y")).alias(years))
        out = out.join(held, "__k", "left").withColumn(years, F.coalesce(years, F.array().cast(dict(held.dtypes)[years])))
    return out.select(F.col(f"__b.{ident}").alias(ident), "merged", last_year, *[F.col(f"__b.{c}").alias(c) for c in carry],
                      *([years] if years else []))


def plant_members(facs: DataFrame, ident: str, registry: str, last_year: str, aliases: DataFrame | None = None) -> DataFrame:
    """(plant, member): every record that is known under another one's id after ``collapse_plants``, one row each."""
    d = _plant_key(facs, ident, registry, aliases)
    names = d.groupBy("__k").agg(F.max_by(ident, F.struct(last_year, ident)).alias("plant"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    met = salted_join(d.select("__k", F.col(ident).alias("member")), names.select("__k", "plant"), ["__k"], ["member"])
    return met.where("member <> plant").select("plant", "member")


def filer_groups(filings: DataFrame, filer: str, kind: str, filed: str, key: Column) -> DataFrame:
    """Spelling variants grouped by a folded key: commonest spelling (ties: earliest filed, then by name), dates, status.

    withdrawal beats motion beats late motion.
    """
    d = filings.withColumn("__k", key)
    sp = d.groupBy("__k", filer).agg(F.count(F.lit(1)).alias("__n"), F.min(filed).alias("__f"))
    name = sp.groupBy("__k").agg(F.min_by(filer, F.struct(-F.col("__n"), "__f", filer)).alias("name"),
                                 F.count(F.lit(1)).alias("variants"))
    rank = F.when(F.col(kind) == "withdrawal", 2).when(F.col(kind) == "motion", 1).otherwise(0)
    g = d.groupBy("__k").agg(F.min(filed).alias("first"), F.max(filed).alias("last"),
                             F.count(F.lit(1)).alias("filings"), F.max(rank).alias("__r"))
    status = F.when(F.col("__r") == 2, "withdrew").when(F.col("__r") == 1, "motion").otherwise("late motion")
    return g.join(name, "__k").select(F.col("__k").alias("key"), "name", "variants", "first", "last", "filings",
                                      status.alias("status"))


def promised_and_actual(df: DataFrame, promised_existing: str, promised_new: str, actual: str) -> DataFrame:
    """Promised total and the difference to the actual figure, only where both are known."""
    total = F.when(F.col(promised_existing).isNotNull(),
                   F.col(promised_existing) + F.coalesce(F.col(promised_new), F.lit(0)))
    return df.withColumn("promised_total", total).withColumn("delta", F.col(actual) - F.col("promised_total"))


def reader_coverage(lines: DataFrame, keys: Sequence[str], reader: str, absent: Column, min_lines: int = 50,
                    rate: float = 0.90) -> DataFrame:
    """Readers that saw almost nothing on pages with plenty of lines."""
    g = lines.groupBy(*keys, reader).agg(F.count(F.lit(1)).alias("lines"), F.count_if(absent).alias("absent"))
    return g.withColumn("absent_rate", F.col("absent") / F.col("lines")).where(
        (F.col("lines") >= min_lines) & (F.col("absent_rate") >= rate))


def detections(df: DataFrame, keys: Sequence[str], date: str, time: str, power: str) -> DataFrame:
    """Detections, distinct overpasses, first and last day, peak power."""
    per = df.groupBy(*keys, date, time).agg(F.count(F.lit(1)).alias("__n"), F.max(power).alias("__p"))
    return per.groupBy(*keys).agg(F.sum("__n").alias("detections"), F.count(F.lit(1)).alias("overpasses"),
                                  F.min(date).alias("first"), F.max(date).alias("last"), F.max("__p").alias("peak"))


def repeat_visitors(df: DataFrame, key: str, watch: DataFrame, at_least: int = 2) -> DataFrame:
    """Keys seen at least so often and not on the watch list."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("visits")).where(F.col("visits") >= at_least)
    return n.join(watch.select(key).distinct(), key, "left_anti")


def ranked_totals(df: DataFrame, group: Sequence[str], item: str, value: str, k: int) -> DataFrame:
    """Top ``k`` items per group; a computed 0 is labelled "no calculated load", not no discharge."""
    g = df.groupBy(*group, item).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("total").desc_nulls_last(), item)
    quality = F.when(F.col("n") == 0, "not reported").when(F.col("total") == 0, "no calculated load").otherwise(
        "calculated")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("quality", quality)


def exceedances(df: DataFrame, group: Sequence[str], year: str, over: Column, amount: Column) -> DataFrame:
    """Exceedances and amount over the limit by group and year."""
    return df.groupBy(*group, year).agg(F.count_if(over).alias("exceedances"),
                                        F.sum(F.when(over, amount)).alias("over_limit"))


def hazard_profile(df: DataFrame, ident: str, losses: Sequence[str], ratings: Sequence[str], scale: Sequence[str],
                   top: int) -> DataFrame:
    """Hazards ranked by loss (missing last, as 0) and whether each holds the record's best rating."""
    best_first = {r: i for i, r in enumerate(scale)}
    ordinal = lambda c: F.coalesce(*[F.when(c == r, i) for r, i in best_first.items()])
    haz = F.array(*[F.struct(F.lit(n).alias("hazard"), F.col(n).cast("double").alias("loss"), F.col(r).alias("rating"))
                    for n, r in zip(losses, ratings)])
    d = df.select(ident, F.explode(haz).alias("h")).select(ident, "h.*").withColumn("__o", ordinal(F.col("rating")))
    w = Window.partitionBy(ident)
    d = d.withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("loss", F.lit(0.0)).desc(), "hazard")))
    return d.withColumn("best_rated", F.coalesce(F.col("__o") == F.min("__o").over(w), F.lit(False))).where(
        F.col("rank") <= top).drop("__o")


def release_points(df: DataFrame, keys: Sequence[str], source: str, item: str, lat: str, lon: str,
                   receptor: tuple[float, float]) -> DataFrame:
    """One row per stack: its sources and items counted and listed once, distance and bearing to a receptor.

    A stack and source (or item) is one row before they are listed, so repeated reports add nothing to a list.
    """
    place = df.groupBy(*keys).agg(F.min(lat).alias(lat), F.min(lon).alias(lon))

    def listed(c: str, name: str) -> DataFrame:
        one = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("__v")).distinct()
        return one.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), F.sort_array(F.collect_list("__v")).alias(f"{name}_list"))

    g = place.join(listed(source, "sources"), list(keys), "left").join(listed(item, "items"), list(keys), "left")
    g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sources", "items")})
    return g.withColumns({
        "to_receptor_m": F.bround(geo.haversine(lat, lon, receptor[0], receptor[1], 6371000.0), 0),
        "bearing": F.pmod(F.bround(geo.bearing(lat, lon, receptor[0], receptor[1]), 0), F.lit(360.0))})


def weighted_indicator(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Population-weighted averages two ways: missing as 0 over all people, and over people with a value."""
    v, w = F.col(value), F.coalesce(F.col(weight), F.lit(0))
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.coalesce(v, F.lit(0.0)) * w), F.nullif(F.sum(w), F.lit(0))).alias("missing_as_zero"),
        F.try_divide(F.sum(v * w), F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0))).alias("known_only"),
        F.count_if(v.isNull()).alias("missing"))


def class_areas(found: DataFrame, sources: DataFrame, places: DataFrame, place: str, code: str, area: str) -> DataFrame:
    """Area and polygons per class at each place; nothing found differs from nothing mapped."""
    g = found.groupBy(place, code).agg(F.count(F.lit(1)).alias("polygons"), F.sum(area).alias("area"))
    mapped = sources.select(place).distinct().withColumn("__m", F.lit(True))
    j = places.select(place).join(g, place, "left").join(mapped, place, "left")
    status = (F.when(F.col("polygons").isNotNull(), "found").when(F.col("__m"), "none_found")
              .otherwise("out_of_coverage"))
    return j.withColumn("status", status).drop("__m")


def stated_and_computed(parts: DataFrame, listed: DataFrame, group: str, part: str, computed: str,
                        stated: str) -> DataFrame:
    """Agreements with stated and mapped area and the number of listed parts the map lacks."""
    got = parts.groupBy(group).agg(F.sum(computed).alias("computed"), F.count(F.lit(1)).alias("mapped_parts"))
    missing = listed.join(parts.select(group, part), [group, part], "left_anti").groupBy(group).agg(
        F.count(F.lit(1)).alias("missing_parts"), F.sum(stated).alias("__ms"))
    all_ = listed.groupBy(group).agg(F.sum(stated).alias("stated"))
    j = all_.join(got, group, "left").join(missing, group, "left").na.fill(0, ["missing_parts", "mapped_parts"])
    return j.withColumn("stated_mapped_parts", F.col("stated") - F.coalesce("__ms", F.lit(0.0))).drop("__ms")


def by_reference(items: DataFrame, keys: Sequence[str], ref: str, source: str, name: str, text: str,
                 official: str) -> DataFrame:
    """Flattened section items grouped by source reference; entries with statements, the official source first."""
    pick = lambda n: F.min(F.when(F.col(name) == n, F.col(text)))
    g = items.groupBy(*keys, ref, source).agg(
        pick("Signal").alias("signal"), F.count_if(F.col(name) == "Statements").alias("statements"),
        pick("Note").alias("note")).where(F.col("statements") > 0)
    w = Window.partitionBy(*keys).orderBy(~F.col(source).startswith(official), source, ref)
    return g.withColumn("rank", F.row_number().over(w))


def tally(df: DataFrame, lists: str) -> DataFrame:
    """How often each listed value occurs, each row counting a value once."""
    return df.select(F.explode(F.array_distinct(lists)).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("hits"))


def tolerant_totals(df: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums of counts that were typed as text, for each of ``counts``: the sum of those that read as whole numbers, rows
    that state anything (``with_``), and rows whose statement is no number (``unreadable_``), which the sum leaves out."""
    said = {c: F.trim(F.col(c).cast("string")) for c in counts}
    number = {c: F.when(v.rlike("^[+-]?[0-9]{1,18}$"), v.cast("long")) for c, v in said.items()}
    out = [F.count(F.lit(1)).alias("reports")]
    for c, v in said.items():
        out += [F.coalesce(F.sum(number[c]), F.lit(0).cast("long")).alias(c), F.count_if(F.coalesce(v, F.lit("")) != "").alias(f"with_{c}"),
                F.count_if((v != "") & number[c].isNull()).alias(f"unreadable_{c}")]
    return df.groupBy(*keys).agg(*out)


def area_shares(samples: DataFrame, keys: Sequence[str], area: str, weight: str) -> DataFrame:
    """Whole percent of each thing's weight that falls in each area, the largest share first. Areas are few by nature."""
    each = samples.groupBy(*keys, area).agg(F.sum(F.col(weight).cast("double")).alias("__w"))
    mine = Window.partitionBy(*keys)
    share = F.bround(F.try_divide(F.lit(100.0) * F.col("__w"), F.sum("__w").over(mine)), 0).cast("long")
    place = F.row_number().over(mine.orderBy(F.col("__w").desc(), area))
    return each.select(*keys, area, share.alias("percent"), place.alias("place"))
