"""Unit conversion and small physical formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor to pounds per year by unit spelling.
POUNDS_PER_YEAR = {
    "tpy": 2000.0, "ton/yr": 2000.0, "tons/yr": 2000.0, "tons/year": 2000.0, "ton/year": 2000.0,
    "tons per year": 2000.0, "lb/yr": 1.0, "lbs/yr": 1.0, "lb/year": 1.0, "lbs/year": 1.0, "pounds/year": 1.0,
    "kg/yr": 2.20462, "kg/year": 2.20462, "tonne/yr": 2204.62, "metric tons/yr": 2204.62,
}
GRAM_UNITS = ["g/yr", "g/year", "grams/yr", "grams/year"]
POUND_HOUR_UNITS = ["lb/hr", "lbs/hr", "lb/hour"]
HOURS_PER_YEAR = 8760.0
GRAMS_PER_POUND = 453.59237
SECONDS_PER_YEAR = 31536000.0
LIFETIME_YEARS = 70.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def yearly_mass(amount, unit, hours=None) -> Column:
    """Struct (value, layer, note). Layer is lb or g; the two are never mixed. Null layer: not convertible."""
    a = _c(amount)
    u = F.regexp_replace(F.lower(F.trim(_c(unit))), r"\s+", " ")
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in POUNDS_PER_YEAR.items() for x in kv]), u)
    h = F.lit(None).cast("double") if hours is None else _c(hours)
    hh = F.coalesce(h, F.lit(HOURS_PER_YEAR))
    value = (F.when(factor.isNotNull(), a * factor).when(u.isin(*POUND_HOUR_UNITS), a * hh)
             .when(u.isin(*GRAM_UNITS), a))
    layer = (F.when(factor.isNotNull() | u.isin(*POUND_HOUR_UNITS), "lb").when(u.isin(*GRAM_UNITS), "g"))
    note = (F.when(factor == 1, "as reported").when(factor.isNotNull(), "converted")
            .when(u.isin(*POUND_HOUR_UNITS) & h.isNull(), "assumes continuous operation")
            .when(u.isin(*POUND_HOUR_UNITS), "stated hours")
            .when(u.isin(*GRAM_UNITS), "grams, kept separate from pounds").otherwise("unit not recognized"))
    ok = a.isNotNull()
    return F.struct(F.when(ok, value).alias("value"), F.when(ok & value.isNotNull(), layer).alias("layer"),
                    F.when(ok, note).otherwise("amount not numeric").alias("note"))


def grams_per_second(amount, unit, hours=None) -> Column:
    """Yearly average rate in g/s."""
    m = yearly_mass(amount, unit, hours)
    direct = F.regexp_replace(F.lower(_c(unit)), r"\s+", "").isin("g/s", "g/sec")
    return (F.when(direct, _c(amount)).when(m["layer"] == "lb", m["value"] * GRAMS_PER_POUND / SECONDS_PER_YEAR)
            .when(m["layer"] == "g", m["value"] / SECONDS_PER_YEAR))


def corrected_pm25(pm_cf1, humidity) -> Column:
    """Published two-range humidity correction of low-cost PM2.5 sensors."""
    pm, rh = _c(pm_cf1), _c(humidity)
    low = F.lit(0.52) * pm - F.lit(0.086) * rh + 5.75
    high = F.lit(0.46) * pm + F.lit(3.93e-4) * pm * pm + 2.97
    return F.when(pm <= 343, low).otherwise(high)


def vortex_frequency(velocity, diameter, is_flare) -> Column:
    """0.2 V / D for stacks; flares have no such estimate."""
    v, d = _c(velocity), _c(diameter)
    return F.when(~_c(is_flare) & (d > 0) & (v > 0), F.lit(0.2) * v / F.nullif(d, F.lit(0.0)))


def sound_speed(temp_c, wind_along) -> Column:
    """Effective speed of sound: temperature part plus the wind component along the path (m/s)."""
    return F.lit(331.3) * F.sqrt(F.lit(1.0) + _c(temp_c) / 273.15) + _c(wind_along)


def cancer_risk(integral, adaf_integral, unit_risk, mutagenic, adaf_share=1.0) -> Column:
    """Lifetime excess risk from the years with evidence; null without a unit risk."""
    i, ai, ure = _c(integral), _c(adaf_integral), _c(unit_risk)
    share = _c(adaf_share) if isinstance(adaf_share, (str, Column)) else F.lit(float(adaf_share))
    base = ure * i / LIFETIME_YEARS
    early = ure * (i + share * (ai - i)) / LIFETIME_YEARS
    return F.when(_c(mutagenic) & ai.isNotNull(), early).otherwise(base)


def hazard_quotient(conc, reference) -> Column:
    return F.try_divide(_c(conc), _c(reference))
