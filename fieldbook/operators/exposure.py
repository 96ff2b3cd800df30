"""Exposure over time at home: days, not averages; unknown years stay unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.units import LIFETIME_YEARS
from fieldbook.operators.temporal import merge_intervals
from fieldbook.plans.skew import salted_join

# Early-life factors by age band (from age, to age, factor), and the assumed birthday, mid year.
AGE_BANDS = [(0, 2, 10.0), (2, 16, 3.0)]
BIRTH_MONTH_DAY = "07-01"


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.datediff(F.least(a1, b1), F.greatest(a0, b0)), F.lit(0))


def period_status(start: str, last: str, open_end: str) -> Column:
    """What becomes of a residence period: ``counted``, or why it can't be. Nothing is counted silently as no time."""
    s, e, now = F.col(start).cast("date"), F.col(last).cast("date"), F.lit(open_end).cast("date")
    return (F.when(s.isNull(), "start unknown").when(e < s, "ends before it starts")
            .when(e.isNull() & (s > now), "starts after the last day known").otherwise("counted"))


def home_years(residence: DataFrame, member: str, start: str, last: str, open_end: str, birth_year: str | None = None,
               window: tuple[str, str | None] | None = None) -> DataFrame:
    """Per member and calendar year: days at home, days exposed, days weighted by age factor, days in the year.

    ``last`` is the last day lived there (inclusive); null means still there, closed by ``open_end``. Overlapping
    periods count once. Only periods that ``period_status`` calls counted add days. ``window`` (inclusive dates) is when the source runs; home time outside it is a known zero.
    """
    end = F.date_add(F.coalesce(F.col(last), F.lit(open_end).cast("date")), 1)
    spans = residence.where(period_status(start, last, open_end) == "counted").select(member, F.col(start).alias("__s"), end.alias("__e"))
    m = merge_intervals(spans, [member], "__s", "__e")
    if birth_year:
        born = residence.groupBy(member).agg(F.min(birth_year).alias(birth_year))
        m = m.join(born, member)
        birth = F.to_date(F.concat(F.col(birth_year).cast("string"), F.lit("-" + BIRTH_MONTH_DAY)))
        # nobody is exposed before being born
        m = m.withColumn("__b", birth).withColumn("__s", F.greatest("__s", F.coalesce("__b", "__s")))
    m = m.where(F.col("__s") < F.col("__e"))
    y = m.withColumn("year", F.explode(F.sequence(F.year("__s"), F.year(F.date_sub("__e", 1)))))
    y0, y1 = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    y = y.withColumns({"__h0": F.greatest("__s", y0), "__h1": F.least("__e", y1), "__n": F.datediff(y1, y0)})
    if window:
        w0 = F.lit(window[0]).cast("date")
        w1 = F.date_add(F.lit(window[1]).cast("date"), 1) if window[1] else F.lit("9999-12-31").cast("date")
        x0, x1 = F.greatest("__h0", w0), F.least("__h1", w1)
    else:
        x0, x1 = F.col("__h0"), F.col("__h1")
    days = F.greatest(F.datediff(x1, x0), F.lit(0))
    aggs = [F.sum(F.datediff("__h1", "__h0")).alias("home_days"), F.sum(days).alias("exposed_days"),
            F.max("__n").alias("year_days")]
    if birth_year:
        weighted = days.cast("double")
        for lo, hi, f in AGE_BANDS:
            b0, b1 = F.add_months("__b", 12 * lo), F.add_months("__b", 12 * hi)
            weighted = weighted + _overlap(x0, x1, b0, b1) * (f - 1.0)
        aggs.append(F.sum(F.when(F.col("__b").isNotNull(), weighted)).alias("weighted_days"))
    return y.groupBy(member, "year").agg(*aggs)


def exposure(years: DataFrame, place_of: DataFrame, series: DataFrame, member: str, place: str, item: str,
             conc: str) -> DataFrame:
    """Integrate each item's annual series over each member's time at home.

    A residence year absent from the series, or null in it, is unknown: it adds nothing and is counted in
    ``unknown_years``. Averages divide by known or exposed time, never by all of it.
    """
    items = series.select(place, item).distinct()
    m = years.join(place_of.select(member, place), member)
    j = salted_join(m, items, [place], [member, "year"]).join(
        series.select(place, item, "year", F.col(conc).alias("__c"), F.lit(True).alias("__row")), [place, item, "year"],
        "left")
    n = F.col("year_days")
    home, exp_ = F.col("home_days") / n, F.col("exposed_days") / n
    unknown = F.col("__c").isNull() & (exp_ > 0)
    c = F.coalesce("__c", F.lit(0.0))
    has_adaf = "weighted_days" in years.columns
    aggs = [
        F.sum(home).alias("residence_years"),
        F.sum(F.when(unknown, home - exp_).otherwise(home)).alias("known_years"),
        F.sum(F.when(unknown, 0.0).otherwise(exp_)).alias("exposed_years"),
        F.sum(F.when(unknown, 0.0).otherwise(c * exp_)).alias("integral"),
        F.max(F.when(~unknown & (exp_ > 0), c)).alias("max_annual"),
        F.count_if(unknown).alias("unknown_years"),
    ]
    if has_adaf:
        aggs.append(F.sum(F.when(~unknown, c * F.col("weighted_days") / n)).alias("adaf_integral"))
    e = j.groupBy(member, item).agg(*aggs)
    return e.withColumns({
        "evidence_fraction": F.try_divide("known_years", "residence_years"),
        "period_average": F.try_divide("integral", F.nullif(F.col("known_years"), F.lit(0.0))),
        "exposed_average": F.try_divide("integral", F.nullif(F.col("exposed_years"), F.lit(0.0))),
        "lifetime_average": F.col("integral") / LIFETIME_YEARS})


def combine_sources(series: DataFrame, keys: Sequence[str], conc: str) -> DataFrame:
    """Sum of several sources' series: null only when none is known; partial years are floors."""
    known, total = F.count(conc), F.count(F.lit(1))
    return series.groupBy(*keys).agg(F.sum(conc).alias(conc), ((known > 0) & (known < total)).alias("partial"))


def hazard_totals(rows: DataFrame, organs: DataFrame, member: str, item: str, risk: str, hq: str) -> DataFrame:
    """Per member: risks add; quotients add only within a target organ; what has no number is counted apart.

    ``organs`` is (item, organ), one row per pair; an item has a handful of organs. The rows are read once.
    """
    lists = organs.groupBy(item).agg(F.collect_list("organ").alias("__o"))
    j = rows.join(lists, item, "left").select(member, risk, hq, F.col("__o").isNotNull().alias("__known"),
                                              F.posexplode_outer("__o").alias("__i", "organ"))
    once = F.coalesce("__i", F.lit(0)) == 0
    part = j.groupBy(member, "organ").agg(
        F.sum(F.when(once, F.col(risk))).alias("risk"), F.count(F.when(once, F.col(risk))).alias("n_risk"),
        F.count_if(once & F.col(risk).isNull()).alias("no_risk"), F.count_if(once & F.col(hq).isNull()).alias("no_hq"),
        F.sum(hq).alias("hi"), F.count_if(~F.col("__known") & F.col(hq).isNotNull()).alias("un"))
    with_index = F.col("organ").isNotNull() & F.col("hi").isNotNull()
    return part.groupBy(member).agg(
        F.sum("risk").alias("cancer_risk"), F.sum("n_risk").alias("cancer_items"),
        F.sum("no_risk").alias("unquantified_cancer"), F.sum("no_hq").alias("unquantified_noncancer"),
        F.max_by("organ", F.when(with_index, F.struct("hi", "organ"))).alias("worst_organ"),
        F.max(F.when(with_index, F.col("hi"))).alias("worst_index"), F.count_if(with_index).alias("organs"),
        F.sum("un").alias("unassigned"))


def series_status(modeled: DataFrame, filed: DataFrame, keys: Sequence[str], years: DataFrame, conc: str,
                  amount: str) -> DataFrame:
    """Every (key, year read): modeled, zero_reported, reported_not_modeled or no_report.

    ``years`` is the list of years read: one row per calendar year, so the grid is keys times tens.
    """
    ys = years.agg(F.sort_array(F.collect_set("year")).alias("ys")).select("ys").scalar()
    grid = modeled.select(*keys).distinct().withColumn("year", F.explode(ys))
    m = modeled.groupBy(*keys, "year").agg(F.sum(conc).alias(conc), F.lit(True).alias("__m"))
    f = filed.groupBy(*keys, "year").agg(F.sum(amount).alias("__f"))
    j = grid.join(m, [*keys, "year"], "left").join(f, [*keys, "year"], "left")
    status = (F.when(F.col("__m"), "modeled").when(F.col("__f").isNull(), "no_report")
              .when(F.col("__f") == 0, "zero_reported").otherwise("reported_not_modeled"))
    return j.withColumn("status", status).withColumn(
        conc, F.when(F.col("status") == "zero_reported", 0.0).otherwise(F.col(conc))).drop("__m", "__f")
