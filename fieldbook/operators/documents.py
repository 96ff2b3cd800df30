"""Facts from document lines, cross-checks, tables, tags, passages, reader votes."""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Mapping, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.functions import dates, text
from fieldbook.operators.temporal import year_runs
from fieldbook.plans.durable import durable
from fieldbook.plans.ordered import islands
from fieldbook.plans.skew import salted_join

# Unit spellings and what they stand for.
UNITS = {"lb/hr": "LB_HR", "lbs/hr": "LB_HR", "lb/hour": "LB_HR", "tpy": "TPY", "tons/yr": "TPY", "tons/year": "TPY",
         "ton/yr": "TPY", "lb/mmbtu": "LB_MMBTU", "lbs/mmbtu": "LB_MMBTU", "mmbtu/hr": "MMBTU_HR",
         "mmbtu/hour": "MMBTU_HR", "%": "PERCENT", "ft": "FT", "feet": "FT", "°f": "DEGF", "deg f": "DEGF",
         "degf": "DEGF", "acfm": "FLOW", "scfm": "FLOW", "dscfm": "FLOW", "gpm": "FLOW"}
# Date roles by keyword, first role that matches wins.
DATE_ROLES = [("issuance", ["issu"]), ("expiration", ["expir"]), ("effective", ["effective"]),
              ("submitted", ["submit", "received"])]
# Identifier patterns.
IDENTIFIERS = {
    "AI_NUMBER": r"(?i)\bA[Il1]\)?\s*(?:No\.?|Number|#)?\s*[:\-]?\s*(\d{3,7})\b",
    "PERMIT_NUMBER": r"\b(\d{4}-\d{4,5}-\d{2})\b",
    "ACTIVITY_NUMBER": r"(?i)\b(PER\d{6,10})\b",
    "EQT_NUMBER": r"(?i)\b(EQT\d{4,8})\b",
}
# Patterns of texts that others write.
NUMERIC_CELL = r"^[\s$(<>~+-]*[\d.,/:%-]*\d[\d.,/:%-]*[\s%)a-zA-Z/]{0,8}$"
ELISION = r"(?i)<!--[^>]*\b(?:rows?|data|omitted|follow|content|continue[sd]?)\b[^>]*-->"
CASE_NUMBER = r"\b(\d{4}-\d+-[A-Z]{1,4}|PZ-\d+\.\d+|(?:DC|ZT)-\d+\.\d+|\d{4}-\d{4})\b"
CASE_COMPANY = r"((?:[A-Z][\w&'-]*\.? ){1,5}?[A-Z][\w&'-]*),? (?:LLC|L\.L\.C\.|Inc\.?|Corporation|Company)\b"
NOTICE_PHRASES = {
    "amount": r"not to exceed (\$[\d,]+)",
    "hearing": r"will hold a public hearing (on .*?),? with respect to",
    "borrower": r"loaned by the Authority to (.+?)\s*\(the [“\"]?(?:Company|Borrower)",
    "location": r"\(the [“\"]?Project[”\"]?\)\s*located at (.+?)(?:;|\.\s)",
    "written_comments": r"([^.]*submit\s+their\s+views\s+in\s+writing\s+to\s[^.]*(?:(?<=\b(?:Mr|Ms|Mrs|Dr|Hon|St))\.[^.]*)*\.)",
}
# Thresholds in tons per year.
THRESHOLDS = {100: "major source, listed pollutant", 250: "major source, other", 10: "single hazardous pollutant",
              25: "all hazardous pollutants"}
# Plausibility rules in order: unit, word in context or none, lowest, highest, strict zero, severity.
PLAUSIBLE = [("LB_HR", None, 0.0, None, False, "RED"), ("TPY", None, 0.0, None, False, "RED"),
             ("LB_MMBTU", None, 0.0, None, False, "RED"), ("PERCENT", "efficiency", 0.0, 100.0, False, "RED"),
             ("PERCENT", "opacity", None, 100.0, False, "RED"), ("FT", "height", 5.0, 600.0, False, "WARN"),
             ("DEGF", "temp", 32.0, 2000.0, False, "WARN"), ("FLOW", None, 0.0, None, True, "RED")]
MONTHS = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t|tember)?|"
          "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
DATE_PATTERN = rf"(?i)\b(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|{MONTHS}\.?\s+\d{{1,2}},?\s+\d{{4}})\b"


def _unit_pattern() -> str:
    import re
    return "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))


def number_facts(lines: DataFrame, keep: Sequence[str], line: str = "line") -> DataFrame:
    """Numbers with units: (keep, context, value, unit). A range dash or an exponent is never read as a minus sign."""
    pattern = rf"(?i)(?<![%\d.])(-?\d[\d,]*\.?\d*(?:e[+-]?\d+)?)\s*({_unit_pattern()})(?!\w)"
    hit = F.explode(F.arrays_zip(text.all_matches(line, pattern, 1).alias("n"), text.all_matches(line, pattern, 2)
                                 .alias("u")))
    d = lines.where(F.col(line).rlike(r"\d")).select(*keep, F.col(line).alias("context"), hit.alias("h"))
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return d.select(*keep, "context", F.regexp_replace("h.n", ",", "").try_cast("double").alias("value"),
                    F.try_element_at(table, F.lower("h.u")).alias("unit")).where(F.col("value").isNotNull())


def date_facts(lines: DataFrame, keep: Sequence[str], line: str = "line") -> DataFrame:
    """Dates with the role the line's words give them, text kept as written."""
    low = F.lower(line)
    role = None
    for name, words in DATE_ROLES:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        role = F.when(cond, name) if role is None else role.when(cond, name)
    d = lines.where(F.col(line).rlike(r"\d")).select(*keep, F.col(line).alias("context"), role.alias("role"), F.explode(
        text.all_matches(line, DATE_PATTERN, 1)).alias("date_text"))
    return d.withColumn("date", dates.mixed_date("date_text"))


def identifier_facts(lines: DataFrame, keep: Sequence[str], line: str = "line",
                     patterns: Mapping[str, str] = IDENTIFIERS) -> DataFrame:
    """Identifiers by kind."""
    def named(kind, pattern):
        return F.transform(text.all_matches(line, pattern, 1),
                           lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    hits = F.flatten(F.array(*[named(k, p) for k, p in patterns.items()]))
    return lines.where(F.col(line).rlike(r"\d")).select(*keep, F.explode(hits).alias("h")).select(
        *keep, "h.kind", "h.value")


def check_threshold(facts: DataFrame, within: float = 0.02) -> DataFrame:
    """Yearly amounts just below a threshold."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in THRESHOLDS]))
    d = facts.where(F.col("unit") == "TPY").withColumn("threshold", t)
    return d.where((F.col("value") < F.col("threshold")) & (
        (F.col("threshold") - F.col("value")) / F.col("threshold") <= within)).withColumn("check", F.lit("THRESHOLD"))


def check_plausibility(facts: DataFrame) -> DataFrame:
    """The first rule each fact breaks."""
    v, low = F.col("value"), F.lower("context")
    chain, sev = None, None
    for i, (unit, word, lo, hi, strict, severity) in enumerate(PLAUSIBLE):
        bad = F.lit(False)
        if lo is not None:
            bad = bad | ((v <= lo) if strict else (v < lo))
        if hi is not None:
            bad = bad | (v > hi)
        cond = (F.col("unit") == unit) & bad
        if word:
            cond = cond & low.contains(word)
        chain = F.when(cond, i) if chain is None else chain.when(cond, i)
        sev = F.when(cond, severity) if sev is None else sev.when(cond, severity)
    return facts.withColumns({"rule": chain, "severity": sev}).where(F.col("rule").isNotNull()).withColumn(
        "check", F.lit("PLAUSIBILITY"))


def check_date_order(dated: DataFrame, doc: Sequence[str], pairs: Sequence[tuple[str, str]] = (
        ("issuance", "expiration"), ("submitted", "effective"))) -> DataFrame:
    """Later-role dates that fall before an earlier-role date of the same document, one row per offending pair.

    Pairs are formed between the two roles' distinct dates of one document only.
    """
    d = dated.where(F.col("date").isNotNull()).groupBy(*doc, "role", "date").agg(F.count(F.lit(1)).alias("__n"))
    out = None
    for early, late in pairs:
        a = d.where(F.col("role") == early).select(*doc, F.col("date").alias("earlier"), F.col("__n").alias("__a"))
        b = d.where(F.col("role") == late).select(*doc, F.col("date").alias("later"), F.col("__n").alias("__b"))
        j = a.join(b, list(doc)).where(F.col("later") < F.col("earlier")).select(
            *doc, F.lit(early).alias("earlier_role"), F.lit(late).alias("later_role"), "earlier", "later",
            (F.col("__a") * F.col("__b")).alias("pairs"))
        out = j if out is None else out.unionByName(j)
    return out


def check_cross_document(idents: DataFrame, doc: str, near: int = 2) -> DataFrame:
    """Kinds with several values over several documents; near when every minority value is within a few edits.

    Majority is the value in most documents (ties: the value seen first, by document). No value list is collected.
    """
    per = idents.select("kind", "value", doc).distinct().groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("docs"), F.min(doc).alias("first_doc"))
    touched = idents.select("kind", doc).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))
    maj = per.groupBy("kind").agg(F.max_by("value", F.struct("docs", -F.col("first_doc"), "value")).alias("majority"),
                                  F.count(F.lit(1)).alias("values"))
    j = per.join(maj, "kind").groupBy("kind", "majority", "values").agg(
        F.bool_and(F.levenshtein("value", "majority") <= near).alias("near_neighbours"))
    return j.join(touched, "kind").where((F.col("values") >= 2) & (F.col("documents") >= 2))


def value_tally(docs: DataFrame, doc: str, body: str, value: str, distance: int = 2) -> DataFrame:
    """Readings of a value over all documents within a few edits, with counts and whether the minority readings occur
    only in documents that also hold the majority reading."""
    n = len(value)
    tok = docs.select(doc, F.explode(F.split(body, r"\s+")).alias("reading"))
    tok = tok.withColumn("reading", F.btrim("reading", F.lit(",;:()[]\"'."))).where(
        F.length("reading").between(max(1, n - distance), n + distance))
    tok = tok.withColumn("distance", F.levenshtein("reading", F.lit(value))).where(F.col("distance") <= distance)
    per = tok.groupBy("reading", "distance", doc).agg(F.count(F.lit(1)).alias("__n"))
    r = per.groupBy("reading", "distance").agg(F.sum("__n").alias("hits"), F.count(F.lit(1)).alias("documents"))
    top = r.agg(F.min_by("reading", F.struct(-F.col("hits"), "distance", "reading")).alias("m")).select("m").scalar()
    has = per.groupBy(doc).agg(F.bool_or(F.col("reading") == top).alias("__maj"), F.count(F.lit(1)).alias("__k"))
    confined = has.agg(F.bool_and(F.col("__maj")).alias("c")).select("c").scalar()
    return r.withColumns({"majority": F.col("reading") == top, "minority_confined": confined})


# ---- tables

def cell_number(col: str) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(F.col(col), F.lit("")), r"(-?\d[\d,]*\.?\d*(?:[eE][+-]?\d+)?)", 1),
                            ",", "").try_cast("double")


def _header(cells: DataFrame, table: Sequence[str], keywords: Mapping[str, str]) -> DataFrame:
    """(table, header_row, heads): the row with most keyword hits and its (col, units) entries."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.filter(F.array(*[F.when(low.contains(k), F.lit(u)) for k, u in keywords.items()]), lambda x: x.isNotNull())
    d = cells.select(*table, "row", "col", hits.alias("__h")).where(F.size("__h") > 0)
    rows = d.groupBy(*table, "row").agg(F.sum(F.size("__h")).alias("__n"), F.collect_list(F.struct("col", "__h")).alias("heads"))
    return rows.groupBy(*table).agg(F.min_by(F.struct("row", "heads"), F.struct(-F.col("__n"), "row")).alias("__b")).select(
        *table, F.col("__b.row").alias("header_row"), F.col("__b.heads").alias("heads"))


def header_map(cells: DataFrame, table: Sequence[str], keywords: Mapping[str, str]) -> DataFrame:
    """(table, header_row, unit, col): the row with most keyword hits names the columns; the last match wins."""
    h = _header(cells, table, keywords).select(*table, "header_row", F.explode("heads").alias("e"))
    return h.select(*table, "header_row", "e.col", F.explode("e.__h").alias("unit")).groupBy(
        *table, "header_row", "unit").agg(F.max("col").alias("col"))


def table_rows(cells: DataFrame, table: Sequence[str], keywords: Mapping[str, str]) -> DataFrame:
    """One row per data row: label (column 0) and a number per unit, with ``<unit>_seen`` for blank cells.

    The header travels to its table's cells in one join; rows are then built where the table's cells already are.
    """
    units = sorted(set(keywords.values()))
    at = {u: F.array_max(F.transform(F.filter("heads", _holds(u)), lambda e: e["col"])) for u in units}
    h = _header(cells, table, keywords).select(*table, "header_row", *[c.alias(f"__c_{u}") for u, c in at.items()])
    d = cells.join(h.hint("merge"), list(table)).where(F.col("row") != F.col("header_row"))  # never whole tables through the driver
    is_unit = {u: F.col("col") == F.col(f"__c_{u}") for u in units}
    return d.groupBy(*table, "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("text"))).alias("label"),
        *[F.max(F.when(c, cell_number("text"))).alias(u) for u, c in is_unit.items()],
        *[F.max(F.when(c, F.trim(F.coalesce("text", F.lit(""))))).alias(f"{u}_seen") for u, c in is_unit.items()])


def _holds(unit: str):
    return lambda e: F.array_contains(e["__h"], unit)


def check_rate_against_year(rows: DataFrame) -> DataFrame:
    """Yearly tons against the hourly rate at full hours: above by 2 % is wrong, below by 5 % needs hours."""
    most = F.col("LB_HR") * 4.38
    sev = F.when(F.col("TPY") > most * 1.02, "RED").when(F.col("TPY") < most * 0.95, "CONFIRM")
    return rows.where(F.col("LB_HR") > 0).withColumns({"severity": sev, "expected": most}).where(
        F.col("severity").isNotNull())


def check_heat(rows: DataFrame) -> DataFrame:
    """Rate per heat times heat input must give the hourly rate within 5 %."""
    e = F.col("LB_MMBTU") * F.col("MMBTU_HR")
    return rows.withColumn("expected", e).where(
        (F.col("LB_HR") != 0) & (F.abs(e - F.col("LB_HR")) / F.abs(F.nullif(F.col("LB_HR"), F.lit(0.0))) > 0.05))


def check_subtotal(rows: DataFrame, table: Sequence[str], unit: str) -> DataFrame:
    """Tables with exactly one total row whose value differs from the sum of the others."""
    is_total = F.lower(F.coalesce("label", F.lit(""))).contains("total")
    g = rows.groupBy(*table).agg(
        F.count_if(is_total).alias("__t"), F.max(F.when(is_total, F.col(unit))).alias("stated"),
        F.sum(F.when(~is_total, F.col(unit))).alias("parts_sum"))
    tol = F.greatest(F.col("stated") * 0.005, F.lit(0.1))
    return g.where((F.col("__t") == 1) & (F.abs(F.col("parts_sum") - F.col("stated")) > tol)).drop("__t")


def check_blank_cells(rows: DataFrame, units: Sequence[str]) -> DataFrame:
    """Blank cells in numeric columns of rows that hold some number; a wholly blank row is a spacer."""
    seen = [F.col(f"{u}_seen") for u in units]
    some = F.lit(False)
    for s in seen:
        some = some | (s.isNotNull() & (s != ""))
    blank = F.filter(F.array(*[F.when(s == "", F.lit(u)) for u, s in zip(units, seen)]), lambda x: x.isNotNull())
    return rows.where(some).withColumn("unit", F.explode(blank))


# ---- pages laid out in boxes

def visual_rows(lines: DataFrame, page: Sequence[str], tol: float = 0.6) -> DataFrame:
    """Give each boxed line its visual row: a line joins the current row when its centre is near the row's mean.

    The rule runs down one page at a time over that page's own lines (an array), inside the JVM.
    """
    d = lines.where(F.trim("text") != "").withColumns({"__yc": (F.col("y0") + F.col("y1")) / 2,
                                                      "__h": F.col("y1") - F.col("y0")})
    item = F.struct(F.col("__yc").alias("y"), "x0", "x1", "text")
    g = d.groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("ls"), F.percentile("__h", 0.5).alias("mh"))
    lim = F.when(F.col("mh") > 0, F.col("mh")).otherwise(1.0) * tol
    zero = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"),
                    F.array().cast("array<int>").alias("rows"))

    def step(acc, l):
        join = (acc.n > 0) & (F.abs(l.y - acc["sum"] / F.greatest(acc.n, F.lit(1))) <= lim)
        row = F.when(join | (acc.n == 0), acc.row).otherwise(acc.row + 1)
        return F.struct(row.alias("row"), F.when(join, acc["sum"] + l.y).otherwise(l.y).alias("sum"),
                        F.when(join, acc.n + 1).otherwise(1).alias("n"),
                        F.concat(acc.rows, F.array(row)).alias("rows"))
    g = g.withColumn("rows", F.aggregate("ls", zero, step)["rows"])
    z = F.explode(F.arrays_zip("ls", "rows")).alias("z")
    return g.select(*page, z).select(*page, F.col("z.rows").alias("row"), "z.ls.x0", "z.ls.x1", "z.ls.text")


def page_features(lines: DataFrame, page: Sequence[str], width: float, narrow: float = 0.30, col_tol: float = 0.02,
                  lookahead: int = 6) -> DataFrame:
    """Per page: lines, rows, cell rows, column clusters, aligned header, numeric share, tabular and strong flags."""
    from pyspark.sql import Window
    r = durable(visual_rows(lines, page).select(  # read four times below
        *page, "row", "x0", "x1", F.trim("text").rlike(NUMERIC_CELL).alias("__numeric")))
    w = F.col("x1") - F.col("x0")
    numeric = F.col("__numeric")
    rows = r.groupBy(*page, "row").agg(F.count(F.lit(1)).alias("n"), F.min(w).alias("wmin"), F.max(w).alias("wmax"),
                                       F.count_if(numeric).alias("num"), F.min("x0").alias("left"))
    cell = (F.col("n") >= 2) & (F.col("wmin") < narrow * width)
    base = rows.groupBy(*page).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("rows"),
                                   F.count_if(cell).alias("cell_rows"),
                                   (F.sum("num") / F.sum("n")).alias("numeric_frac"))
    lefts = r.join(rows.where(cell).select(*page, "row"), [*page, "row"]).select(*page, "x0")
    wx = Window.partitionBy(*page).orderBy("x0")
    lefts = lefts.withColumn("__new", F.when(F.col("x0") - F.lag("x0").over(wx) <= col_tol * width, 0).otherwise(1))
    lefts = lefts.withColumn("__c", F.sum("__new").over(wx.rowsBetween(Window.unboundedPreceding, 0)))
    cols = lefts.groupBy(*page, "__c").agg(F.count(F.lit(1)).alias("n")).groupBy(*page).agg(
        F.count_if(F.col("n") >= 3).alias("columns"))
    tol = col_tol * width
    heads = rows.where((F.col("n") >= 4) & (F.col("wmax") < narrow * width)).select(*page, "row")
    order = Window.partitionBy(*page, "row").orderBy("x0")
    hc = r.join(heads, [*page, "row"]).withColumn("__i", F.row_number().over(order)).where("__i > 1").select(
        *page, F.col("row").alias("__head"), F.col("__i"), F.col("x0").alias("__x"),
        F.explode(F.sequence(F.col("row") + 1, F.col("row") + lookahead)).alias("row"))
    hc = hc.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__x") - tol) / tol), F.floor((F.col("__x") + tol) / tol))))
    below = r.where(w < narrow * width).select(*page, "row", "x0", F.floor(F.col("x0") / tol).alias("__b"))
    al = hc.join(below, [*page, "row", "__b"]).where(F.abs(F.col("x0") - F.col("__x")) <= tol).select(
        *page, "__head", "__i").distinct().groupBy(*page, "__head").agg(F.count(F.lit(1)).alias("n"))
    head = al.where("n >= 2").select(*page).distinct().withColumn("header_row", F.lit(True))
    f = base.join(cols, list(page), "left").join(head, list(page), "left")
    f = f.withColumns({"columns": F.coalesce("columns", F.lit(0)), "header_row": F.coalesce("header_row", F.lit(False))})
    f = f.withColumn("tabular", ((F.col("cell_rows") >= 4) & (F.col("columns") >= 2)) | F.col("header_row"))
    return f.withColumn("strong", F.col("tabular") & (F.col("columns") >= 3))


def with_neighbours(pages: DataFrame, doc: Sequence[str], page: str, flag: str) -> DataFrame:
    """Flagged pages and the existing pages right before and after them."""
    hit = pages.where(F.col(flag)).select(*doc, F.explode(F.array(F.col(page) - 1, F.col(page), F.col(page) + 1)).alias(page))
    return pages.join(hit.distinct(), [*doc, page], "left_semi")


def page_selection(pages: DataFrame, doc: Sequence[str], page: str, flag: str, neighbours: bool = True,
                   whole_share: float = 0.5) -> DataFrame:
    """One row per document: its pages, flagged and selected ones, the selection as text (``3-5,9``), and what to send:
    ``none``, ``pages``, or ``whole`` once at least ``whole_share`` of the pages are selected."""
    chosen = with_neighbours(pages, doc, page, flag) if neighbours else pages.where(F.col(flag))
    chosen = chosen.select(*doc, page).distinct()
    total = pages.groupBy(*doc).agg(F.countDistinct(page).alias("pages"), F.count_if(F.col(flag)).alias("flagged"))
    spec = year_runs(chosen, doc, page, "spec", ",")
    out = total.join(chosen.groupBy(*doc).agg(F.count(F.lit(1)).alias("selected")), list(doc), "left").join(spec, list(doc), "left")
    out = out.na.fill(0, ["selected"]).na.fill("", ["spec"])
    advice = F.when(F.col("selected") == 0, "none").when(F.col("selected") >= F.col("pages") * whole_share, "whole").otherwise("pages")
    return out.withColumn("advice", advice)


# ---- reader votes

def _exact(target: str, left: list, most: int):
    """The first run of reader units that reads exactly as the target."""
    for a, (_, unit) in enumerate(left):
        if not target.startswith(unit):
            continue
        joined = unit
        for b in range(a + 1, min(a + most, len(left)) + 1):
            if joined == target:
                return a, b
            if b == len(left) or not target.startswith(joined):
                break
            joined += f" {left[b][1]}"
    return None


_GRAM, _BINS = 4, 1024
_COMMON = 4096  # letters below this are told apart by a table


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Bin of each piece of ``_GRAM`` letters; equal pieces have equal bins."""
    h = np.zeros(max(0, len(codes) - _GRAM + 1), dtype=np.uint32)
    for k in range(_GRAM):
        h = (h ^ codes[k:k + len(h)]) * np.uint32(0x9E3779B1)
    return h >> np.uint32(22)


class _Counts:
    """Letters and pieces of letters that the units of a page hold, counted once; ``left`` are the numbers of those still free."""

    def __init__(self, units: list[str]):
        codes = _codes("".join([" ", *units]))
        if codes.max() < _COMMON:
            found = np.flatnonzero(np.bincount(codes))
            place = np.zeros(found[-1] + 1, dtype=np.int64)
            place[found] = np.arange(len(found))
            at = place[codes]
        else:
            found, at = np.unique(codes, return_inverse=True)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        self.column = {chr(c): k for k, c in enumerate(found.tolist())}
        self.letters = np.bincount(unit * len(found) + at[1:], minlength=len(units) * len(found)).reshape(len(units), len(found))
        whole = unit[:max(0, len(unit) - _GRAM + 1)] == unit[_GRAM - 1:]
        bins = _grams(codes[1:])[whole]
        self.pieces = np.bincount(unit[:len(whole)][whole] * _BINS + bins, minlength=len(units) * _BINS).astype(np.int32).reshape(len(units), _BINS)
        self.lengths = np.array([len(u) for u in units], dtype=np.int64)
        self.free(range(len(units)))

    def free(self, left):
        self.left = np.array(left, dtype=np.int64)
        self.letters_before = _before(self.letters[self.left])
        self.lengths_before = _before(self.lengths[self.left])
        self._pieces_before = None

    @property
    def pieces_before(self):
        if self._pieces_before is None:
            self._pieces_before = _before(self.pieces[self.left])
        return self._pieces_before


def _before(x: np.ndarray) -> np.ndarray:
    """Sums over the rows before each row, and over all."""
    out = np.zeros((len(x) + 1, *x.shape[1:]), dtype=x.dtype)
    np.cumsum(x, axis=0, out=out[1:])
    return out


def _percent(matched, total):
    return 100.0 * (2.0 * matched / total)


LONG_RUN = 200  # characters from which the published matcher starts a block at rare letters only


def _windows(target: str, left: list, most: int, counts: _Counts):
    """Runs of reader units whose similarity could reach 75, with an upper bound of it.

    A run goes on only if the letters both hold, counted whatever their order, could make 75. The bound of a short one is
    the longest common subsequence, kept as a bit row that grows with the run (published bit-parallel method); block
    matching can never match more characters than it. In a run of ``LONG_RUN`` characters every block but one at the very
    start holds a letter that is rare there, so blocks are few; and of each all but ``_GRAM`` - 1 letters begin a piece of
    ``_GRAM`` letters that both texts hold.
    """
    n = len(target)
    column, lengths = counts.column, counts.lengths_before
    starts, ends = _spans(len(left), most)
    size = lengths[ends] - lengths[starts] + (ends - starts - 1)
    near = np.flatnonzero(_percent(np.minimum(size, n), n + size) >= 75.0)
    if not len(near):
        return
    starts, ends, size = starts[near], ends[near], size[near]
    have = np.zeros(len(column), dtype=np.int64)
    for ch in set(target):
        if ch in column:
            have[column[ch]] = target.count(ch)
    has = counts.letters_before[ends] - counts.letters_before[starts]
    has[:, column[" "]] += ends - starts - 1
    both = np.minimum(has, have)
    matched = both.sum(axis=1)
    long = np.flatnonzero((size >= LONG_RUN) & (_percent(matched, n + size) >= 75.0))
    if len(long):
        blocks = (both[long] * (has[long] <= (size[long] // 100 + 1)[:, None])).sum(axis=1) + 1
        own = np.bincount(_grams(_codes(target)), minlength=_BINS)
        joints = ends[long] - starts[long] - 1
        pieces = np.minimum(counts.pieces_before[ends[long]] - counts.pieces_before[starts[long]], own).sum(axis=1) + _GRAM * joints
        matched[long] = np.minimum(matched[long], pieces + (_GRAM - 1) * blocks)
    bounds = _percent(matched, n + size)
    short: dict[int, dict[int, int]] = {}
    for k in np.flatnonzero(bounds >= 75.0).tolist():
        a, b = int(starts[k]), int(ends[k])
        if size[k] >= LONG_RUN:
            yield a, b, " ".join(u for _, u in left[a:b]), float(bounds[k])
        else:
            short.setdefault(a, {})[b] = int(size[k])
    if not short:
        return
    full = (1 << n) - 1
    mask: dict[str, int] = {}
    for k, ch in enumerate(target):
        mask[ch] = mask.get(ch, 0) | (1 << k)
    get = mask.get
    for a, wanted in short.items():
        last = max(wanted)
        row, joined = full, ""
        most_missed = 0.625 * wanted[last] - 0.375 * n + 1e-6  # letters left out, beyond which no run reaches 75
        for b in range(a + 1, last + 1):
            unit = left[b - 1][1]
            grown = f" {unit}" if b > a + 1 else unit
            before = len(joined)
            joined += grown
            for k in range(0, len(grown), 32):
                for ch in grown[k:k + 32]:
                    m = get(ch)
                    if m:
                        hit = row & m
                        row = ((row + hit) | (row - hit)) & full
                if before + min(k + 32, len(grown)) - (n - row.bit_count()) > most_missed:
                    break
            else:
                if b in wanted and (bound := _percent(n - row.bit_count(), n + len(joined))) >= 75.0:
                    yield a, b, joined, bound
                continue
            break


@functools.lru_cache(maxsize=1024)
def _spans(units: int, most: int):
    """Starts and ends of all runs of up to ``most`` of so many units."""
    starts = np.repeat(np.arange(units), np.minimum(most, units - np.arange(units)))
    return starts, starts + 1 + np.concatenate([np.arange(min(most, units - a)) for a in range(units)] or [starts])


def _rare(target: str, joined: str) -> dict[str, list[int]]:
    """Places in a long run of those letters of the target that are rare in it, as the published matcher has it."""
    often = len(joined) // 100 + 1
    places = {}
    for ch in set(target):
        if 0 < joined.count(ch) <= often:
            js = places[ch] = []
            j = joined.find(ch)
            while j >= 0:
                js.append(j)
                j = joined.find(ch, j + 1)
    return places


def _seed(rows: list, blo: int, bhi: int):
    """First longest run of rare letters that both texts hold in the part: its start in either, and its length."""
    size, i0, j0 = 0, 0, 0
    before, last, runs = -2, (), {}
    for i, js in rows:
        if js[0] < blo or js[-1] >= bhi:
            js = js[bisect.bisect_left(js, blo):bisect.bisect_left(js, bhi)]
            if not js:
                continue
        if not size:
            size, i0, j0 = 1, i, js[0]
        grown = {}
        if i == before + 1:
            for j in js:
                if j - 1 in last:
                    k = grown[j] = runs.get(j - 1, 1) + 1
                    if k > size:
                        size, i0, j0 = k, i - k + 1, j - k + 1
        before, last, runs = i, js, grown
    return size, i0, j0


def _similarity(target: str, joined: str, least: float) -> float:
    """Similarity by the published block matching (``difflib.SequenceMatcher``), or 0 where it is below ``least``.

    In a run of ``LONG_RUN`` characters blocks start at letters that are rare there, so the few places where those meet
    stand for the text; and a pair is given up once the parts that are still open cannot make ``least``.
    """
    total = len(target) + len(joined)
    if len(joined) < LONG_RUN:
        return 100.0 * difflib.SequenceMatcher(None, target, joined).ratio()
    rare = _rare(target, joined)
    rows = [(i, rare[ch]) for i, ch in enumerate(target) if ch in rare]
    at = [i for i, _ in rows]
    matched, could = 0, min(len(target), len(joined))
    parts = [(0, len(target), 0, len(joined))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        size, i, j = _seed(rows[bisect.bisect_left(at, alo):bisect.bisect_left(at, ahi)], blo, bhi)
        if not size:
            i, j = alo, blo
        while i > alo and j > blo and target[i - 1] == joined[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and target[i + size] == joined[j + size]:
            size += 1
        could -= min(ahi - alo, bhi - blo)
        if size:
            matched += size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    parts.append(part)
                    could += min(part[1] - part[0], part[3] - part[2])
        if _percent(matched + could, total) < least:
            return 0.0
    return _percent(matched, total)


def _vote(want: list[str], units: list[str], most: int = 12):
    """Match normalised lines, longest first, to runs of normalised reader units; a used unit is gone. One page at a time.

    Of a line's runs the most similar wins, of equal ones the first. Gives each line's verdict and the numbers of the units
    it was matched to.
    """
    left = list(enumerate(units))
    counts = None
    figures = lambda t: "".join(filter(str.isdecimal, t))
    verdicts = ["absent"] * len(want)
    runs_of = [[] for _ in want]
    for i in sorted(range(len(want)), key=lambda k: -len(want[k])):
        target = want[i]
        if not target:
            continue
        best, span = 0.0, _exact(target, left, most)
        if span:
            best = 100.0
        elif left:
            counts = counts or _Counts(units)
            if len(counts.left) != len(left):
                counts.free([k for k, _ in left])
            digits = None
            for a, b, joined, bound in sorted(_windows(target, left, most, counts), key=lambda r: (-r[3], r[0], r[1])):
                if bound < best:
                    break
                if bound == best and (a, b) > span:
                    continue
                if digits is None:
                    digits = figures(target)
                got = figures(joined) if digits else ""
                cap = 89.0 if got and got != digits else 100.0
                if cap < best or (cap == best and (a, b) > span):
                    continue
                score = min(_similarity(target, joined, max(75.0, best)), cap)
                if score > best or (score == best and span and (a, b) < span):
                    best, span = score, (a, b)
        if span and best >= 75:
            verdicts[i] = "agree" if best >= 90 else "dissent"
            runs_of[i] = [k for k, _ in left[span[0]:span[1]]]
            del left[span[0]:span[1]]
    return verdicts, runs_of


def reader_votes(lines: DataFrame, units: DataFrame, page: Sequence[str], reader: str) -> DataFrame:
    """Each page line's verdict per reader: agree (90 and over), dissent (75 to 89), absent; and the text that was matched.

    ``lines`` has line_no and line, ``units`` unit_no and unit per page and reader. ``place`` is the first matched unit
    (from 0) and ``reading`` what the reader has there, as read; both are null where the line is absent. Pages are the
    groups: what one page prints bounds a group, and pages spread over the cluster. Lines and units go to their page together,
    once, and not at all where both lie by a part of the page's key already.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    ls = lines.select(*page, none(units, reader), "line_no", none(units, "unit_no"), F.col("line").alias("unit"), F.lit(True).alias("__line"))
    us = units.select(*page, reader, none(lines, "line_no"), "unit_no", "unit", F.lit(False).alias("__line"))
    pages = ls.unionByName(us).dropna(subset=list(page)).groupBy(*page).agg(
        F.collect_list(F.when(F.col("__line"), F.struct("line_no", "unit"))).alias("ls"),
        F.collect_list(F.when(~F.col("__line"), F.struct(reader, "unit_no", "unit"))).alias("us")).where((F.size("ls") > 0) & (F.size("us") > 0))
    normal = lambda c: text.normal_texts(F.transform(c, lambda x: F.coalesce(x["unit"], F.lit(""))))
    pages = pages.withColumns({"__ls": normal("ls"), "__us": normal("us")})
    pages = pages.select(
        *page, F.sort_array(F.zip_with("ls", "__ls", lambda l, t: F.struct(l["line_no"].alias("line_no"), t.alias("__t")))).alias("ls"),
        F.zip_with("us", "__us", lambda u, t: F.struct(u[reader].alias("__reader"), F.struct(
            u["unit_no"].alias("unit_no"), u["unit"].alias("unit"), t.alias("__t")).alias("__u"))).alias("__all"))
    pages = pages.withColumn(reader, F.explode(F.array_distinct(F.transform("__all", lambda u: u["__reader"]))))
    own = F.filter("__all", lambda u: u["__reader"].eqNullSafe(F.col(reader)))
    pages = pages.withColumn("us", F.sort_array(F.transform(own, lambda u: u["__u"])))
    out = T.ArrayType(T.StructType([T.StructField("verdict", T.StringType()), T.StructField("run", T.ArrayType(T.IntegerType()))]))

    @F.pandas_udf(out)
    def vote(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"verdict": v, "run": r} for v, r in zip(*_vote(list(x), list(y)))] for x, y in zip(a, b)])
    v = pages.select(
        *[F.col(c).cast(lines.schema[c].dataType).alias(c) for c in page], reader, "ls", "us", vote(F.transform("ls", lambda l: l["__t"]), F.transform("us", lambda u: u["__t"])).alias("v"))
    v = v.select(*page, reader, "us", F.explode(F.arrays_zip("ls", "v")).alias("z"))
    run = F.col("z.v.run")
    reading = F.array_join(F.transform(run, lambda k: F.element_at("us", k + 1)["unit"]), " ")
    return v.select(*page, reader, F.col("z.ls.line_no").alias("line_no"), "z.v.verdict",
                    F.when(F.size(run) > 0, run[0]).cast("long").alias("place"), F.when(F.size(run) > 0, reading).alias("reading"))


def elision_marks(df: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """How often a reader left a placeholder comment instead of text."""
    return df.select(*keep, F.regexp_count(body, F.lit(ELISION)).alias("elisions")).where(F.col("elisions") > 0)


# ---- tags, tracking, passages

def tag_items(items: DataFrame, keep: Sequence[str], body: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """(keep, category, match): categories whose patterns occur, with the first text that matched."""
    hits = F.filter(F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_substr(body, F.lit(
        "(?i)" + "|".join(f"(?:{p})" for p in ps))).alias("match")) for c, ps in categories.items()]),
        lambda h: h.match.isNotNull())
    return items.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.category", "h.match")


def case_keys(body: Column) -> Column:
    """Search keys of a case title: case numbers and company names; the title itself when there are none."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (CASE_NUMBER, CASE_COMPANY)]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(body))


KEY_CHARS = 16_000_000  # of the watch list that one scan of the texts looks for


def key_hits(items: DataFrame, item_id: str, body: str, keys: DataFrame, key: str, chars: int = KEY_CHARS) -> DataFrame:
    """(item_id, key): the distinct keys of the column ``key`` that each text contains.

    The keys make a pattern automaton that reads a text once, whatever their number and length. A list beyond ``chars``
    characters is split by hash into that many automata, each with a scan of its own, so that what a task holds is
    bounded. Null and empty keys and texts meet nothing.
    """
    spark = items.sparkSession
    own = keys.select(F.col(key).alias("__key")).where(F.length(key) > 0).distinct()
    total = own.agg(F.sum(F.length("__key"))).first()[0] or 0
    texts = items.where(F.length(body) > 0).select(item_id, body)
    out = f"{item_id} {dict(items.dtypes)[item_id]}, __key string"
    shards = max(1, -(-total // chars))
    found = None
    for s in range(shards):
        sent = spark.sparkContext.broadcast([r[0] for r in own.where(F.pmod(F.xxhash64("__key"), F.lit(shards)) == s).collect()])

        def scan(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for i, k in enumerate(sent.value):
                automaton.add_word(k, i)
            automaton.make_automaton()
            for b in batches:
                rows, hits = [], []
                for n, text in enumerate(b.column(1).to_pylist()):
                    met = {i for _, i in automaton.iter(text)} if len(sent.value) else ()
                    rows += [n] * len(met)
                    hits += [sent.value[i] for i in met]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())],
                                                 names=[item_id, "__key"])

        part = texts.mapInArrow(scan, out)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("__key", key)


WIDE_ITEM = 256  # distinct keys in one text


def _others(held: str, key: str) -> list[Column]:
    """Two words of marks of the keys in ``held`` other than ``key``: sets whose marks meet in no bit of either word share none."""
    rest = F.filter(held, lambda x: x != F.col(key))
    word = lambda shift: F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(x), shift).bitwiseAND(F.lit(63)).cast("int"))))
    return [word(0), word(6)]


def track_cases(items: DataFrame, item_id: str, body: str, cases: DataFrame, case_id: str, title: str) -> DataFrame:
    """Items that contain a key of a case, with the number of keys found. Each text is read once for all keys.

    A company's name may be in a third of the texts and in thousands of cases, so pairs of items and cases never travel: an
    item carries its keys, a case its own, and a pair is written where they meet on the least key they share. Two words of
    marks on either side tell nearly all pairs that share no other key, so that lists are compared for the rest alone. Only
    items of more than ``WIDE_ITEM`` different keys, or with an id that holds some keys more often than others, are counted
    by grouping their pairs.
    """
    k = cases.select(case_id, F.explode(F.transform(case_keys(F.col(title)), lambda x: F.lower(x))).alias("__key")).where(
        F.col("__key") != "").distinct()
    hits = durable(key_hits(items.select(item_id, F.lower(body).alias("__t")), item_id, "__t", k, "__key"))
    held = hits.groupBy(item_id, "__key").agg(F.count(F.lit(1)).alias("__n")).groupBy(item_id).agg(
        F.collect_list("__key").alias("__held"), F.min("__n").alias("__n"), F.max("__n").alias("__most"))
    plain = (F.size("__held") <= WIDE_ITEM) & (F.col("__n") == F.col("__most"))
    one, two = _others("__held", "__key")
    narrow = durable(held.where(plain).select(item_id, "__n", "__held", F.explode("__held").alias("__key")).withColumns(
        {"__h1": one, "__h2": two}))
    one, two = _others("__own", "__key")
    own = k.groupBy(case_id).agg(F.collect_list("__key").alias("__own")).select(
        case_id, "__own", F.explode("__own").alias("__key")).withColumns({"__o1": one, "__o2": two})
    shared = F.array_intersect("__held", "__own")
    lone = (F.col("__h1").bitwiseAND(F.col("__o1")) == 0) | (F.col("__h2").bitwiseAND(F.col("__o2")) == 0)
    few = salted_join(narrow, own, ["__key"], [item_id]).where(lone | (F.array_min(shared) == F.col("__key"))).select(
        item_id, case_id, F.when(lone, F.col("__n")).otherwise(F.col("__n") * F.size(shared)).alias("keys"))
    wide = hits.join(held.where(~plain).select(F.col(item_id).alias("__wide")), F.col(item_id).eqNullSafe(F.col("__wide")), "left_semi")
    many = salted_join(durable(wide), k, ["__key"], [item_id]).groupBy(item_id, case_id).agg(F.count(F.lit(1)).alias("keys"))
    return few.unionByName(many)


def passages(lines: DataFrame, keys: Sequence[str], pattern: str, gap: int = 2, around: int = 1) -> DataFrame:
    """Runs of matching lines (gap up to ``gap``) as one passage with a line of context each side."""
    hit = lines.where(F.col("line").rlike(pattern)).select(*keys, "line_no")
    d = islands(hit, keys, ["line_no"],
                F.col("line_no") - F.col("prev.line_no") > gap, ["line_no"], "passage")
    g = d.groupBy(*keys, "passage").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
                                        F.count(F.lit(1)).alias("hits"))
    span = g.withColumn("line_no", F.explode(F.sequence(F.col("first_line") - around, F.col("last_line") + around)))
    ctx = span.join(lines.where(F.trim("line") != "").select(*keys, "line_no", F.trim("line").alias("line")),
                    [*keys, "line_no"])
    return ctx.groupBy(*keys, "passage", "first_line", "last_line", "hits").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), " ").alias("context"))


def term_search(docs: DataFrame, doc: str, body: str, terms: Sequence[str], least: int = 200) -> DataFrame:
    """Hits per form-feed page; a text shorter than ``least`` has no text layer, which is not "no hits"."""
    d = docs.withColumn("status", F.when(F.length(F.trim(body)) < least, "needs OCR").otherwise("searched"))
    rx = "(?i)" + "|".join(terms)
    p = d.select(doc, "status", F.posexplode(F.split(body, "\f")).alias("__p", "__t"))
    g = p.select(doc, "status", (F.col("__p") + 1).alias("page"), F.when(
        F.col("status") == "searched", F.regexp_count("__t", F.lit(rx))).alias("hits"))
    return g.where((F.col("status") != "searched") | (F.col("hits") > 0))


def phrase_history(versions: DataFrame, keys: Sequence[str], order: str, body: str, pattern: str) -> DataFrame:
    """First and last version that holds a phrase, how many do, and how often it occurs."""
    d = versions.withColumn("__n", F.regexp_count(body, F.lit("(?i)" + pattern)))
    hit = F.col("__n") > 0
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("versions"), F.count_if(hit).alias("with_phrase"),
                                F.min(F.when(hit, F.col(order))).alias("first_seen"),
                                F.max(F.when(hit, F.col(order))).alias("last_seen"), F.sum("__n").alias("matches"))


def docket_fields(items: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """Docket id, capped par amount with bond type, other dollar amounts, volume-cap flag."""
    par = (r"Not exceeding \$([\d,]+(?:\.\d+)?)\s+((?:[A-Z(][\w&()/-]*\s+){0,7}?"
           r"(?:Bonds?|Notes?|Certificates?(?: of Indebtedness)?|Obligations?|Loans?|Warrants?))\b")
    raw = F.nullif(F.regexp_extract(body, par, 1), F.lit(""))
    money = lambda c: F.floor(F.regexp_replace(c, ",", "").try_cast("double")).cast("long")
    amounts = F.regexp_extract_all(F.col(body), F.lit(r"\$([\d,]+(?:\.\d+)?)"), F.lit(1))
    at = F.array_position(amounts, raw)
    others = F.when(raw.isNull(), amounts).otherwise(F.filter(amounts, lambda a, i: i + 1 != at))
    others = F.filter(others, lambda a: F.regexp_replace(a, ",", "") != "")
    return items.select(
        *keep, F.nullif(F.regexp_extract(body, r"^([A-Z]{1,2}\d{2}-\d{3}[A-Z]?)\s+-\s", 1), F.lit("")).alias("docket"),
        money(raw).alias("par_amount"),
        F.nullif(F.trim(F.regexp_replace(F.regexp_extract(body, par, 2), r"\s*\([^)]*\)", "")), F.lit("")).alias("bond_type"),
        F.transform(others, money).alias("other_amounts"), F.lower(body).contains("volume cap").alias("volume_cap"))


def notice_fields(df: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """One column for each phrase of a public notice, white space squeezed, null when not stated."""
    stated = {name: F.regexp_replace(F.regexp_extract(body, f"(?is){p}", 1), r"\s+", " ") for name, p in NOTICE_PHRASES.items()}
    return df.select(*keep, *[F.nullif(F.trim(c), F.lit("")).alias(name) for name, c in stated.items()])


def verify_citations(claims: DataFrame, records: DataFrame, cite: str, reporter: str, docket: str, caption: str,
                     year: str, circuit: str) -> DataFrame:
    """Each citation against the record: reporter, else docket, else caption; then its own year and court.

    Matches are counted, and the one match (if one) is carried, so no list of cases is built.
    """
    one = F.struct(F.col(docket).alias("docket"), F.col(year).alias("year"), F.col(circuit).alias("circuit"),
                   F.col(reporter).alias("reporter"))
    out = claims
    for i, key in enumerate((reporter, docket, caption)):
        g = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{i}")).agg(
            F.countDistinct(docket).alias(f"__n{i}"), F.min(one).alias(f"__r{i}"))
        out = out.join(g, out[key] == g[f"__k{i}"], "left")
    how = (F.when(F.col("__n0") > 0, "reporter citation").when(F.col("__n1") > 0, "docket")
           .when(F.col("__n2") > 0, "caption"))
    n = F.coalesce("__n0", "__n1", "__n2", F.lit(0))
    r = F.when(F.col("__n0") > 0, F.col("__r0")).when(F.col("__n1") > 0, F.col("__r1")).otherwise(F.col("__r2"))
    out = out.withColumns({"matched_by": how, "matches": n, "__r": r})
    clash = lambda name, mine, theirs: F.when(mine.isNotNull() & theirs.isNotNull() & (mine != theirs), F.lit(name))
    conflicts = F.concat_ws(",", clash("year", F.col(year), F.col("__r.year")),
                            clash("court", F.col(circuit), F.col("__r.circuit")),
                            clash("reporter", F.col(reporter), F.col("__r.reporter")))
    alone = (F.col("matches") == 1) | (F.col("matched_by") == "docket")
    status = (F.when(F.col("matches") == 0, "not found").when(~alone, "ambiguous")
              .when(conflicts != "", "conflicting").otherwise("found"))
    return out.select(cite, "matched_by", "matches", status.alias("status"), F.when(alone, conflicts).otherwise("")
                      .alias("conflicts"))
