"""Dates as public records write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mixed_date(col) -> Column:
    """Serial day numbers, m/d/yyyy text, month names and ISO prefixes to a date; unreadable gives null."""
    s = F.nullif(F.trim(_c(col).cast("string")), F.lit(""))
    serial = F.when(s.rlike(r"^\d+(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"),
                                                          F.floor(s.try_cast("double")).cast("int")))
    slash = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"),
                   F.to_date(F.try_to_timestamp(F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/y"))))
    short = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _two_digit(s))
    return F.coalesce(serial, slash, short, month_name_date(s),
                      F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date")))


def _two_digit(s: Column) -> Column:
    """m/d/yy with the 69 pivot of the usual two-digit rule."""
    y = F.regexp_extract(s, r"/(\d{2})$", 1).try_cast("int")
    full = F.when(y >= 69, y + 1900).otherwise(y + 2000)
    head = F.regexp_extract(s, r"^(\d{1,2}/\d{1,2}/)", 1)
    return F.to_date(F.try_to_timestamp(F.concat(head, full.cast("string")), F.lit("M/d/y")))


def month_name_date(col) -> Column:
    """``January 5, 2024``, ``Jan 5 2024`` or ``Jan. 5, 2024``."""
    s = F.regexp_replace(F.trim(_c(col)), r"[.,]", "")
    s = F.initcap(F.regexp_replace(s, r"\s+", " "))
    ok = s.rlike(r"^[A-Z][a-z]{2,8} \d{1,2} \d{4}$")
    mon = F.regexp_replace(s, r"^([A-Z][a-z]{2})[a-z]*", "$1")
    return F.when(ok, F.to_date(F.try_to_timestamp(mon, F.lit("MMM d y"))))


def fiscal_year(date, first_month: int = 7) -> Column:
    """Fiscal year named by its closing calendar year."""
    d = _c(date)
    return F.year(d) + F.when(F.month(d) >= first_month, 1).otherwise(0)


def fiscal_label(date, first_month: int = 7) -> Column:
    """``FY16`` style label, named by the closing year."""
    return F.concat(F.lit("FY"), F.lpad(F.pmod(fiscal_year(date, first_month), F.lit(100)).cast("string"), 2, "0"))


def night_of(ts, zone: str) -> Column:
    """The local day a night belongs to: days begin at noon, so both halves share a key."""
    return F.to_date(F.from_utc_timestamp(_c(ts), zone) - F.expr("INTERVAL 12 HOURS"))
