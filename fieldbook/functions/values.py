"""Values that may be missing, coded or not trusted. Unknown is never turned into zero here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; keeps the expression tree small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentinel_null(col, sentinels: Sequence, zero_is_missing: bool = False) -> Column:
    """Null for blanks, sentinels and, where zero means "no value", zero."""
    v = F.nullif(F.trim(_c(col).cast("string")), F.lit("")).try_cast("double")
    bad = v.isin(*[float(s) for s in sentinels])
    if zero_is_missing:
        bad = bad | (v == 0)
    return F.when(~bad, v)


def number_or_status(col, codes: Mapping[str, str]) -> tuple[Column, Column]:
    """(value, status): a number when there is one, else what the code says; never a magic value."""
    s = F.trim(_c(col).cast("string"))
    v = F.regexp_replace(s, ",", "").try_cast("double")
    st = F.when(v.isNotNull(), F.lit("value"))
    for code, meaning in codes.items():
        st = st.when(F.upper(s) == code.upper(), F.lit(meaning))
    st = st.when(s.isNull() | (s == ""), F.lit("not reported")).otherwise(F.lit("unreadable"))
    return v, st


def trusted_number(value, form_filed, migrated, zero_allowed: bool = True) -> Column:
    """A zero counts only where the form was filed and not carried over from an older system."""
    v = _c(value).cast("double")
    ok = F.coalesce(_c(form_filed), F.lit(False)) & ~F.coalesce(_c(migrated), F.lit(False))
    zero = F.when(ok & F.lit(zero_allowed), F.lit(0.0))
    return F.when(v == 0, zero).otherwise(v)


def null_sum_status(value) -> dict[str, Column]:
    """Aggregates: sum (null if nothing known), whether it is partial, and a word for it."""
    v = _c(value)
    known, total = F.count(v), F.count(F.lit(1))
    return {
        "total": F.sum(v),
        "partial": (known > 0) & (known < total),
        "status": F.when(known == 0, "unknown").when(known < total, "floor").otherwise("total"),
    }


def two_figures(col, figures: int = 2) -> Column:
    """Round to significant figures; zero and null stay."""
    v = _c(col).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(float(figures - 1)) - F.floor(F.log10(F.abs(F.nullif(v, F.lit(0.0))))))
    return F.when(v == 0, 0.0).otherwise(F.bround(v * scale, 0) / scale)


def plain_no(col) -> Column:
    """True only for the spellings of a plain no (or nothing said)."""
    v = F.upper(F.trim(F.coalesce(_c(col).cast("string"), F.lit(""))))
    return v.isin("", "N/A", "NA", "N", "NO", "FALSE", "NONE")


def decode(code, table: Mapping[str, str]) -> Column:
    """Coded-list lookup; an unknown code comes back as itself, null stays null."""
    c = _c(code).cast("string")
    kv = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*kv), c), c)


def nested(col, path: str, default=None) -> Column:
    """Dotted path into JSON text with a default."""
    v = F.get_json_object(_c(col), "$." + path)
    return v if default is None else F.coalesce(v, F.lit(default))


def yes_flags(flags: Column, prefix: str) -> Column:
    """From a map of flag columns: names (without prefix) set to Yes, then free-text "other" entries."""
    mine = F.map_filter(flags, lambda k, v: k.startswith(prefix))
    yes = F.map_filter(mine, lambda k, v: (v == "Yes") & ~k.rlike("(None|NoneRequired)$"))
    other = F.map_filter(mine, lambda k, v: k.contains("Other") & v.isNotNull() & ~v.isin("", "No", "Yes"))
    names = F.transform(F.array_sort(F.map_keys(yes)), lambda k: F.substring(k, len(prefix) + 1, F.length(k)))
    texts = F.transform(F.array_sort(F.map_values(other)), lambda v: F.concat(F.lit("other: "), v))
    return F.concat(names, texts)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    chain = None
    for cond, label in rules:
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(default) if chain is not None else F.lit(default)


def all_given(conditions: Sequence[Column | None]) -> Column:
    """AND of the conditions that were given; with none given everything passes."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out
