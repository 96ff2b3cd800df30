"""Cases with known answers: exposure arithmetic, folding rules, dates, geometry, graphs, documents."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import dates, geo, keys, units, values
from fieldbook.operators import agendas, documents, exposure, graph, joins, series, spatial, temporal

AS_OF = "2026-10-11"


def integrate(spark, conc, periods, birth=None, window=None):
    """Exposure of one member with one item; ``conc`` maps year to a value or None."""
    res = spark.createDataFrame([(1, dt.date.fromisoformat(a), dt.date.fromisoformat(b) if b else None, birth)
                                 for a, b in periods], "m int, s date, e date, born int")
    years = exposure.home_years(res, "m", "s", "e", AS_OF, "born" if birth else None, window)
    ser = spark.createDataFrame([(1, "x", y, v) for y, v in conc.items()] or [(1, "x", 1900, 0.0)],
                                "p int, item string, year int, c double")
    place = spark.createDataFrame([(1, 1)], "m int, p int")
    got = exposure.exposure(years, place, ser, "m", "p", "item", "c").collect()
    return got[0].asDict() if got else None


def test_a_leap_year_is_one_year(spark):
    assert integrate(spark, {2012: 1.0}, [("2012-01-01", "2012-12-31")])["residence_years"] == pytest.approx(1.0)


def test_partial_year_counts_days(spark):
    assert integrate(spark, {2010: 1.0}, [("2010-07-01", "2010-12-31")])["residence_years"] == pytest.approx(184 / 365)


def test_overlapping_periods_count_once(spark):
    e = integrate(spark, {}, [("2011-01-01", "2012-12-31"), ("2012-06-01", "2013-12-31")])
    assert e["residence_years"] == pytest.approx(3.0)


def test_open_period_closes_at_the_given_day(spark):
    assert integrate(spark, {}, [("2026-01-01", None)])["residence_years"] == pytest.approx(284 / 365)


def test_window_inside_residence(spark):
    flat = {y: 2.0 for y in range(2000, 2030)}
    e = integrate(spark, flat, [("2010-01-01", "2014-12-31")], window=("2012-07-01", None))
    assert e["integral"] == pytest.approx(2.0 * (184 / 366 + 2))
    assert e["evidence_fraction"] == pytest.approx(1.0)
    e = integrate(spark, flat, [("2010-01-01", "2014-12-31")], window=("2020-01-01", "2025-12-31"))
    assert e["integral"] == 0 and e["max_annual"] is None and e["known_years"] == pytest.approx(5.0)
    assert e["exposed_average"] is None


def test_long_residence_does_not_dilute_the_quotient(spark):
    flat = {y: 2.0 for y in range(1980, 2020)}
    e = integrate(spark, flat, [("1980-01-01", "2019-12-31")], window=("2000-01-01", "2001-12-31"))
    assert e["exposed_average"] == pytest.approx(2.0)
    assert e["period_average"] == pytest.approx(0.1)
    assert e["lifetime_average"] == pytest.approx(4.0 / 70)


def test_unknown_is_not_zero(spark):
    home = [("2010-01-01", "2012-12-31")]
    for conc in ({2010: 1.0, 2011: None, 2012: 1.0}, {2010: 1.0, 2012: 1.0}):
        e = integrate(spark, conc, home)
        assert e["integral"] == pytest.approx(2.0) and e["unknown_years"] == 1
        assert e["evidence_fraction"] == pytest.approx(2 / 3) and e["period_average"] == pytest.approx(1.0)
    e = integrate(spark, {2010: 1.0, 2011: 0.0, 2012: 1.0}, home)
    assert e["unknown_years"] == 0 and e["period_average"] == pytest.approx(2 / 3)


def test_worked_example_one(spark):
    e = integrate(spark, {2010: 0.4, 2011: None, 2012: 0.6}, [("2010-07-01", "2012-12-31")])
    assert e["residence_years"] == pytest.approx(2.504110, rel=2e-5)
    assert e["known_years"] == pytest.approx(1.504110, rel=2e-5)
    assert e["integral"] == pytest.approx(0.801644, rel=2e-5)
    risk = spark.range(1).select(units.cancer_risk(F.lit(e["integral"]), F.lit(None).cast("double"), F.lit(7.8e-6), F.lit(False))
                                 .alias("r")).first()["r"]
    assert risk == pytest.approx(8.9326e-8, rel=2e-5)
    assert e["exposed_average"] / 30.0 == pytest.approx(0.0177656, rel=2e-5)


def test_worked_example_two(spark):
    e = integrate(spark, {y: 0.2 for y in range(2011, 2028)}, [("2011-01-01", "2027-12-31")], birth=2010)
    assert e["integral"] == pytest.approx(3.4, rel=2e-5)
    assert e["adaf_integral"] == pytest.approx(11.694531, rel=2e-5)
    r = spark.range(1).select(units.cancer_risk(F.lit(3.4), F.lit(e["adaf_integral"]), F.lit(3e-4), F.lit(True)).alias("r"))
    assert r.first()["r"] == pytest.approx(5.011942e-5, rel=2e-5)


def test_time_before_birth_is_not_exposure(spark):
    e = integrate(spark, {y: 0.2 for y in range(2011, 2028)}, [("2005-01-01", "2012-12-31")], birth=2010)
    assert e["residence_years"] == pytest.approx(184 / 365 + 2)


def test_combined_sources_are_floors_when_partial(spark):
    s = spark.createDataFrame([(2010, 1.0), (2010, 2.0), (2011, None), (2011, 3.0), (2012, None)], "y int, c double")
    got = {r["y"]: (r["c"], r["partial"]) for r in exposure.combine_sources(s, ["y"], "c").collect()}
    assert got == {2010: (3.0, False), 2011: (3.0, True), 2012: (None, False)}


def test_id_and_name_folding(spark):
    d = spark.createDataFrame([("71-43-2",), ("0000071432",), ("71432",), ("000",)], "x string")
    assert [r[0] for r in d.select(keys.fold_id("x")).collect()] == ["71432", "71432", "71432", "000"]
    n = spark.createDataFrame([("Fishermen's Assn. of the Gulf, Inc.",), ("Fisherman Assn & Gulf LLC",)], "x string")
    assert [r[0] for r in n.select(keys.fold_filer("x")).collect()] == ["fisherman s assn gulf", "fisherman assn gulf"]
    p = spark.createDataFrame([("St. Charles Parish",), ("Saint Charles",), ("st charles",)], "x string")
    assert {r[0] for r in p.select(keys.fold_place("x")).collect()} == {"stcharles"}
    o = spark.createDataFrame([("ENTERGY LOUISIANA, LLC ELTO",), ("Entergy Louisiana, LLC",)], "x string")
    assert {r[0] for r in o.select(keys.fold_owner("x")).collect()} == {"ENTERGY LOUISIANA"}
    c = spark.createDataFrame([("East Baton Rouge Parish",), ("E. BATON ROUGE",)], "x string")
    assert {r[0] for r in c.select(keys.fold_county("x")).collect()} == {"E BATON ROUGE"}


def test_mixed_dates(spark):
    d = spark.createDataFrame([("45292",), ("1/2/2024",), ("2024-01-03-13:46",), ("Jan. 4, 2024",), ("January 5 2024",),
                               ("1/6/24",), ("nonsense",), ("",)], "x string")
    got = [r[0] for r in d.select(dates.mixed_date("x")).collect()]
    assert got == [dt.date(2024, 1, i) for i in range(1, 7)] + [None, None]
    f = spark.createDataFrame([(dt.date(2015, 7, 1),), (dt.date(2016, 6, 30),)], "x date")
    assert {r[0] for r in f.select(dates.fiscal_label("x")).collect()} == {"FY16"}


def test_dockets(spark):
    d = spark.createDataFrame([("No. 56,123-CA",), ("2023 CA 0578",), ("CW 23-45",), ("2024-CA-0286",), ("95-C-2127",),
                               ("24-CA-123",), ("nothing",)], "x string")
    got = [r[0] and (r[0]["circuit"], r[0]["year"], r[0]["type"], r[0]["number"]) for r in d.select(keys.docket_parts("x")).collect()]
    assert got == [(2, None, "CA", 56123), (1, 2023, "CA", 578), (3, 2023, "CW", 45), (4, 2024, "CA", 286), (0, 1995, "C", 2127),
                   (5, 2024, "CA", 123), None]
    hint = spark.createDataFrame([("2024-CA-0286",)], "x string").select(keys.docket_parts("x", 0)["circuit"]).first()[0]
    assert hint == 0
    bare = spark.createDataFrame([("18-279", 3), ("No. 2023-0578", 1), ("18-279", None)], "x string, c int").select(
        keys.docket_parts("x", F.col("c")).alias("p")).collect()
    assert [r["p"] and (r["p"]["circuit"], r["p"]["year"], r["p"]["number"], r["p"]["key"]) for r in bare] == [
        (3, 2018, 279, "appeal:3:2018::279"), (1, 2023, 578, "appeal:1:2023::578"), None]


def test_headers_are_met_by_name(spark, tmp_path):
    from fieldbook.sources import delimited
    (tmp_path / "a.csv").write_text("\ufeff2. ID,37. LINE,65. TOTAL\n1,x,5\n2,y\n")
    (tmp_path / "b.csv").write_text("65. TOTAL,2. ID,90. MORE\n7,3,z\n")
    got = delimited.read_decorated_csv(spark, str(tmp_path), ["2. ID", "37. LINE", "65. TOTAL"]).orderBy("2").collect()
    assert [tuple(r) for r in got] == [("1", "x", "5"), ("2", "y", None), ("3", None, "7")]


def test_reversed_periods_are_named_and_add_nothing(spark):
    import datetime as dt
    day = dt.date
    rows = [("m", day(2010, 1, 1), day(2010, 12, 31)), ("m", day(2012, 5, 1), day(2012, 4, 1)), ("m", None, day(2011, 1, 1)),
            ("m", day(2030, 1, 1), None)]
    res = spark.createDataFrame(rows, "m string, s date, e date")
    said = [r[0] for r in res.select(exposure.period_status("s", "e", "2026-10-11")).collect()]
    assert said == ["counted", "ends before it starts", "start unknown", "starts after the last day known"]
    assert [(r["year"], r["home_days"]) for r in exposure.home_years(res, "m", "s", "e", "2026-10-11").collect()] == [(2010, 365)]


def test_visible_text_of_odd_pages(spark):
    from fieldbook.sources import markup
    pages = {"<P title='a>b'>x &amp; y&nbsp;z</P><!-- <p>no --><b>w</b>v": "x & y z\nwv",
             "<svg><style>a</style>b</svg>c<br/>d<script>if (a<b) {}</script >e": "c\nde",
             "a < b and &lt;p&gt;<pre>k</pre>": "a < b and <p>\nk", "u<script>never closed": "u", "": "", None: None}
    d = spark.createDataFrame([(k,) for k in pages], "x string")
    assert {r["x"]: r["t"] for r in d.select("x", markup.visible_text("x").alias("t")).collect()} == pages


def test_values(spark):
    d = spark.createDataFrame([(123.456,), (0.00123,), (0.0,), (None,), (-98765.0,)], "x double")
    assert [r[0] for r in d.select(values.two_figures("x")).collect()] == [120.0, 0.0012, 0.0, None, -99000.0]
    u = spark.createDataFrame([(2.0, "TPY"), (3.0, "lb/hr"), (4.0, "g/yr"), (5.0, "cups"), (None, "tpy")], "a double, u string")
    got = [(r[0]["value"], r[0]["layer"]) for r in u.select(units.yearly_mass("a", "u")).collect()]
    assert got == [(4000.0, "lb"), (26280.0, "lb"), (4.0, "g"), (None, None), (None, None)]


def test_radius_join_equals_brute_force_everywhere(spark):
    r = random.Random(8)
    spots = [(r.uniform(-89.5, 89.5), r.uniform(-180, 180)) for _ in range(150)]
    spots += [(10 + r.uniform(-1, 1), 179.5 + r.uniform(0, 0.49)) for _ in range(30)]
    spots += [(10 + r.uniform(-1, 1), -179.99 + r.uniform(0, 0.5)) for _ in range(30)]
    spots += [(30.0, -91.0)] * 40  # one crowded place
    l = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "a int, lat double, lon double")
    q = l.select(F.col("a").alias("b"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    for radius in (30.0, 400.0):
        got = {(x["a"], x["b"]) for x in spatial.radius_join(l, q, radius, salt_by=["a"], rows_per_split=5).collect()}
        want = {(x["a"], x["b"]) for x in l.crossJoin(q).where(
            geo.haversine("lat", "lon", "rlat", "rlon") <= radius).collect()}
        assert got == want


def _union_find(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        p[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    n, r = 120, random.Random(1)
    edges = {"random": [(r.randrange(n), r.randrange(n)) for _ in range(70)], "chain": [(i, i + 1) for i in range(n - 1)],
             "star": [(5, i) for i in range(0, n, 2)]}[kind]
    e = spark.createDataFrame(edges, "a int, b int")
    got = graph.connected_components(spark.range(n).select(F.col("id").cast("int").alias("id")), e)
    assert {x["id"]: x["component"] for x in got.collect()} == _union_find(n, edges)


def test_close_edges_chain_like_all_pairs(spark):
    r = random.Random(4)
    pts = [(i, 30 + r.uniform(0, 0.06), -91 + r.uniform(0, 0.06), r.choice("xy")) for i in range(120)]
    pts += [(200 + i, 30.01, -90.99, "x") for i in range(20)]
    d = spark.createDataFrame(pts, "id int, lat double, lon double, g string")
    e = graph.close_edges(d, "id", "lat", "lon", "g", 0.5)
    got = {x["id"]: x["component"] for x in graph.connected_components(d, e).collect()}

    def dist(p, q):
        a, b = map(math.radians, (p[1], q[1]))
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(h))
    index = {p[0]: i for i, p in enumerate(pts)}
    pairs = [(index[p[0]], index[q[0]]) for p in pts for q in pts if p[0] < q[0] and p[3] == q[3] and dist(p, q) <= 0.5]
    uf = _union_find(len(pts), pairs)
    want = {p[0]: pts[uf[index[p[0]]]][0] for p in pts}
    assert got == want


def test_number_facts_keep_ranges_and_exponents(spark):
    d = spark.createDataFrame([(1, "70%-99% 1.30E-03 lb/hr, -5 tpy and 1,200.5 tons/yr")], "n int, line string")
    got = {(x["value"], x["unit"]) for x in documents.number_facts(d, ["n"]).collect()}
    assert got == {(70.0, "PERCENT"), (99.0, "PERCENT"), (0.0013, "LB_HR"), (-5.0, "TPY"), (1200.5, "TPY")}


def test_reader_votes(spark):
    lines = spark.createDataFrame([(1, 1, "Permit 7777-00936-00 issued"), (1, 2, "The quick brown fox jumps"), (1, 3, "Nothing like it here")],
                                  "p int, line_no int, line string")
    unit = spark.createDataFrame([(1, "r", 1, "The quick brown"), (1, "r", 2, "fox jumps"), (1, "r", 3, "Permit 777-00936-00 issued")],
                                 "p int, r string, unit_no int, unit string")
    got = {x["line_no"]: x["verdict"] for x in documents.reader_votes(lines, unit, ["p"], "r").collect()}
    assert got == {1: "dissent", 2: "agree", 3: "absent"}


def test_vote_equals_the_unpruned_search():
    import difflib
    import re
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "12", "345"]
    for _ in range(25):
        lines = [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(6)]
        unit = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(8)]
        want, left = ["absent"] * len(lines), list(unit)
        norm = lambda t: t
        for i in sorted(range(len(lines)), key=lambda k: -len(norm(lines[k]))):
            best, span = -1, None
            t = norm(lines[i])
            for a in range(len(left)):
                for b in range(a + 1, min(a + 12, len(left)) + 1):
                    j = " ".join(norm(u) for u in left[a:b])
                    s = difflib.SequenceMatcher(None, t, j).ratio() * 100
                    da, db = re.sub(r"\D", "", t), re.sub(r"\D", "", j)
                    s = min(s, 89 if da and db and da != db else 100)
                    if s > best:
                        best, span = s, (a, b)
            if best >= 75:
                want[i] = "agree" if best >= 90 else "dissent"
                del left[span[0]:span[1]]
        assert documents._vote(lines, unit)[0] == want


def test_case_tracking_with_many_and_short_keys(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    keys = sorted({"".join(r.choices(letters, k=r.choice([1, 2, 2, 2, 3, 5]))) for _ in range(9000)})
    assert len(keys) > 2000
    texts = [" ".join("".join(r.choices(letters, k=r.randint(0, 6))) for _ in range(4)) for _ in range(60)] + ["", "q7", "plan q7 now"]
    items = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cases = spark.createDataFrame(list(enumerate(keys)), "c int, title string")
    got = documents.track_cases(items, "i", "t", cases, "c", "title").collect()
    want = {(i, c) for i, t in enumerate(texts) for c, k in enumerate(keys) if k in t}
    assert {(x["i"], x["c"]) for x in got} == want and len(got) == len(want)


def test_a_hundred_thousand_keys_in_one_scan_or_several(spark):
    r = random.Random(12)
    keys = sorted({f"{r.randrange(10**6):06d}-{r.choice('abcdé')}" for _ in range(130_000)})[:100_000] + ["0", "é"]
    texts = [f"x {r.randrange(10**6):06d}-{r.choice('abcdé')} y {r.randrange(10**6):06d}-a" for _ in range(200)] + ["", None]
    items = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    watch = spark.createDataFrame([(k,) for k in keys + keys[:50] + ["", None]], "w string")
    known, want = set(keys), set()
    for i, t in enumerate(texts):
        parts = {t[a:a + n] for n in (1, 8) for a in range(len(t) - n + 1)} if t else set()
        want |= {(i, k) for k in parts & known}
    for chars in (documents.KEY_CHARS, 300_000):
        got = [tuple(x) for x in documents.key_hits(items, "i", "t", watch, "w", chars).collect()]
        assert len(got) == len(want) and set(got) == want
    assert documents.key_hits(items, "i", "t", watch.where("false"), "w").collect() == []


def test_case_tracking_both_ways(spark):
    items = spark.createDataFrame([(1, "Ordinance 2024-12-CUP for Delta Works"), (2, "delta workshop"), (3, "2024-1-CUP"), (4, "none")],
                                  "i int, t string")
    cases = spark.createDataFrame([(1, "rezoning 2024-12-CUP for Delta Works, LLC"), (2, "case 2024-1-CUP")], "c int, title string")
    got = documents.track_cases(items, "i", "t", cases, "c", "title").collect()
    spread = documents.track_cases(items.repartition(5), "i", "t", cases.repartition(3), "c", "title").collect()
    assert sorted(got) == sorted(spread)
    assert {(x["i"], x["c"], x["keys"]) for x in got} == {(1, 1, 2), (2, 1, 1), (3, 2, 1)}


def _numbered(spark, *bodies):
    d = spark.createDataFrame(list(enumerate(bodies)), "k int, b string")
    got = agendas.agenda_items(d, ["k"], "b").orderBy("k", "item_no").collect()
    return [[(x["number"], x["title"], x["section"]) for x in got if x["k"] == k] for k in range(len(bodies))]


def test_agenda_numbering(spark):
    body = "PUBLIC HEARINGS\n7. Zoning\n   a) Lot one\n      1. Drainage\n      2. Access\n   b) Lot two\n8. Budget of\nS. Teegarden\n"
    hangs = "1. Title\n      AN ORDINANCE IN CAPITALS\nNEW BUSINESS\nL24-001 - Bonds\r\n  a. part\n  b. part\nM24-002A - Notes"
    got = _numbered(spark, body, None, "", "no items here", hangs)
    assert got[0] == [
        ("7", "Zoning", "PUBLIC HEARINGS"), ("7.a", "Lot one", "PUBLIC HEARINGS"), ("7.a.1", "Drainage", "PUBLIC HEARINGS"),
        ("7.a.2", "Access", "PUBLIC HEARINGS"), ("7.b", "Lot two", "PUBLIC HEARINGS"),
        ("8", "Budget of S. Teegarden", "PUBLIC HEARINGS")]
    assert got[1:4] == [[], [], []]
    assert got[4] == [("1", "Title AN ORDINANCE IN CAPITALS", ""), ("L24-001", "Bonds", "NEW BUSINESS"), ("L24-001.a", "part", "NEW BUSINESS"),
                      ("L24-001.b", "part", "NEW BUSINESS"), ("M24-002A", "Notes", "NEW BUSINESS")]


def test_generated_agendas_give_their_trees_back(spark):
    r = random.Random(8)
    bodies, trees = [], []
    for k in range(40):
        lines, want = [], []

        def grow(path, depth, section):
            for i in range(r.randint(1, 5) if depth < 4 else 0):
                label = str(i + 1) if depth % 2 == 0 else chr(ord("a") + i)
                title = " ".join(r.choices(["permit", "of", "lot", "road"], k=3))
                lines.append("   " * depth + label + r.choice(". ) ".split()) + " " + title)
                if r.random() < 0.3:
                    lines.append("   " * depth + r.choice(["   more text", "J. Smith", "", "      IN CAPITAL LETTERS"]))
                    title = " ".join(f"{title} {lines[-1]}".split())
                want.append((".".join([*path, label]), title, section))
                if r.random() < 0.5:
                    grow([*path, label], depth + 1, section)
        for section in r.sample(["OLD BUSINESS", "PUBLIC HEARINGS", "REPORTS"], 2):
            lines.append(section)
            grow([], 0, section)
        bodies.append("\n".join(lines))
        trees.append(want)
    assert _numbered(spark, *bodies) == trees


def test_a_very_long_agenda(spark):
    body = "REPORTS\n" + "\n".join(f"{i % 90 + 1}. item {i}\n   wrapped" for i in range(5000))
    got = _numbered(spark, body)[0]
    assert len(got) == 5000 and got[4999][1] == "item 4999 wrapped"


def test_minutes_paragraphs(spark):
    long = "It was moved and seconded that the report be received."
    body = f"CALL TO ORDER\n{long}\n\n  \nPage 2\n\nORDINANCE 12\n{long}\nREPORTS\n{long[:30]}\n  {long[31:]}\n"
    d = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, f"{long}\x01")], "k int, b string")
    got = [tuple(x) for x in agendas.minutes_paragraphs(d, ["k"], "b").orderBy("k", "para").collect()]
    assert got == [(1, "p1", long, "CALL TO ORDER"), (1, "p2", f"ORDINANCE 12 {long}", "CALL TO ORDER"), (1, "p3", long, "REPORTS"),
                   (4, "p1", long, "")]


def test_rule_rows_change_the_labels(spark):
    from fieldbook.functions.register import label_by_rules
    items = spark.createDataFrame([(1, "a permit to fill wetlands"), (2, "tax roll"), (3, None), (4, "")], "i int, t string")
    first = spark.createDataFrame([(2, "permit", "permits"), (1, "wet", "water"), (3, None, "never"), (2, "perm", "tie")], "o int, p string, l string")
    label = lambda rules: {x["i"]: x["topic"] for x in label_by_rules(items, "t", rules, "o", "p", "l", "topic", "other").collect()}
    assert label(first) == {1: "water", 2: "other", 3: "other", 4: "other"}
    assert label(first.where("o = 2")) == {1: "tie", 2: "other", 3: "other", 4: "other"}
    assert label(first.where("false")) == dict.fromkeys((1, 2, 3, 4), "other")
    with pytest.raises(ValueError):
        label_by_rules(items, "t", spark.range(1001).selectExpr("id o", "'x' p", "'y' l"), "o", "p", "l", "topic")
    with pytest.raises(ValueError):
        label_by_rules(items, "t", first.drop("l"), "o", "p", "l", "topic")


def test_reader_text_beside_the_vote(spark):
    lines = spark.createDataFrame([(1, 1, "Total VOC 12.5 tpy"), (1, 2, "Permit 7777"), (1, 3, "missing line of text")], "p int, line_no int, line string")
    units = spark.createDataFrame([(1, "x", 5, "<td>Total VOC"), (1, "x", 6, "12.5 TPY</td>"), (1, "x", 7, "Permit 7771")],
                                  "p int, r string, unit_no int, unit string")
    got = {x["line_no"]: (x["verdict"], x["place"], x["reading"]) for x in documents.reader_votes(lines, units, ["p"], "r").collect()}
    assert got == {1: ("agree", 0, "<td>Total VOC 12.5 TPY</td>"), 2: ("dissent", 2, "Permit 7771"), 3: ("absent", None, None)}


def test_unicode_texts_against_plain_code(spark):
    from fieldbook.functions import text
    t = ["Ünïcode  ﬁne | Straße\n---- \n<td>x</td>\u00a0y\u2003z", "", None, "a\n\n\n\n b ,c;; d\t.\n, e ŁØ\u0301 é\u3000", "  日本 § 5 [12]"]
    d = spark.createDataFrame(list(enumerate(t)), "i int, t string")
    got = d.select("i", text.normal_text("t").alias("n"), text.speakable("t", [(r"\[(\d+)\]", "reference $1")], {"§": "section"}).alias("s")).orderBy(
        "i").collect()
    assert [x["n"] for x in got] == ["ünïcode fine strasse x y z", "", None, "a b ,c;; d . , e łǿ é", "日本 § 5 [12]"]
    assert [x["s"] for x in got] == ["Unicode fine | Straße\n----\n<td>x</td> y z", "", None, "a\n\nb,c; d.\ne ŁØ\u0301 e", "日本 section 5 reference 12"]


def test_interior_points_lie_inside(spark):
    import math
    r = random.Random(6)
    shapes = [[[[0, 0], [9, 0], [9, 9], [8, 9], [8, 1], [1, 1], [1, 9], [0, 9], [0, 0]]],
              [[[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]], [[1, 1], [7, 1], [7, 7], [1, 7], [1, 1]]]]
    for _ in range(30):
        n = r.randint(3, 12)
        ring = [[math.cos(2 * math.pi * i / n) * r.uniform(0.05, 3), math.sin(2 * math.pi * i / n) * r.uniform(0.05, 3)] for i in range(n)]
        shapes.append([[*ring, ring[0]]])
    rows = [(i, [[[float(v) for v in p] for p in ring] for ring in s]) for i, s in enumerate(shapes)]
    d = spark.createDataFrame(rows, "i int, rings array<array<array<double>>>").select("i", "rings", geo.interior_point(F.col("rings")).alias("p"))
    got = d.select("i", geo.inside(F.col("p.x"), F.col("p.y"), F.col("rings")).alias("ok")).collect()
    assert [x["i"] for x in got if not x["ok"]] == [] and len(got) == 32
    flat = spark.createDataFrame([(1, [[[1.0, 2.0], [3.0, 2.0], [1.0, 2.0]]])], "i int, rings array<array<array<double>>>")
    assert tuple(flat.select(geo.interior_point(F.col("rings")).alias("p")).first()["p"]) == (1.0, 2.0)


def test_a_second_route_where_the_first_does_not_pass(spark):
    # main 1 -> 2 -> 3; a branch 2 -> 4 -> 5 that loops back to 2, a longer way 1 -> 4, a reach above the start, one beside it all
    rows = [(10, 1, 2, 1, [[0.0, 0.0], [10.0, 0.0]]), (11, 2, 3, 1, [[10.0, 0.0], [20.0, 0.0]]), (12, 2, 4, 2, [[10.0, 0.0], [10.0, 5.0], [10.0, 10.0]]),
            (13, 4, 5, 2, [[10.0, 10.0], [20.0, 10.0]]), (14, 5, 2, 2, [[20.0, 10.0], [10.0, 0.0]]), (15, 1, 4, 2, [[0.0, 0.0], [0.0, 30.0], [10.0, 10.0]]),
            (16, 0, 1, 1, [[-10.0, 0.0], [0.0, 0.0]]), (17, 8, 9, 2, [[0.0, -50.0], [9.0, -50.0]]), (18, None, 9, 2, [[0.0, -60.0], [9.0, -60.0]])]
    reaches = spark.createDataFrame(rows, "reach int, head int, tail int, route int, c array<array<double>>")
    length = lambda c: sum(math.dist(a, b) for a, b in zip(c, c[1:]))
    edges = reaches.join(spark.createDataFrame([(r[0], length(r[4])) for r in rows], "reach int, length double"), "reach")
    starts = spark.createDataFrame([(1, -4.0), (1, -2.0), (None, 0.0)], "node int, m double")
    m = spatial.route_metres(edges, starts, "reach", "head", "tail", "length")
    assert {x["reach"]: x["head_m"] for x in m.collect()} == {10: -4.0, 15: -4.0, 11: 6.0, 12: 6.0, 13: 16.0, 14: 26.0}
    assert {x["reach"] for x in spatial.route_metres(edges, starts, "reach", "head", "tail", "length", 10.0).collect()} == {10, 15, 11, 12}
    points = spark.createDataFrame([(1, 15.0, 0.5), (2, 15.0, 10.5), (3, 2.0, 0.0), (4, 4.0, -50.0), (5, 15.0, 30.0), (6, 10.0, 0.0), (7, None, 1.0)],
                                   "p int, x double, y double")
    got = spatial.along_routes(points, reaches, m, "p", "x", "y", "reach", "c", "route", 1.0).collect()
    assert {x["p"]: (x["route"], x["along_m"], x["off_m"]) for x in got} == {1: (1, 11.0, 0.5), 2: (2, 21.0, 0.5), 6: (1, 6.0, 0.0)}
    none = spatial.route_metres(edges, starts.where("node IS NULL"), "reach", "head", "tail", "length")
    assert none.collect() == []


def test_peaks_against_a_plain_loop(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(3):
        f = np.arange(1, 65, dtype=float)
        v = rng.normal(size=64) * 5
        pr = np.array([v[i] - np.median(v[(f >= f[i] / 2 ** (1 / 3)) & (f <= f[i] * 2 ** (1 / 3))]) for i in range(64)])
        want = []
        for i in range(1, 63):
            if 3 <= f[i] <= 60 and v[i] >= v[i - 1] and v[i] >= v[i + 1] and pr[i] >= 2:
                if want and i - want[-1] <= 3:
                    if pr[i] > pr[want[-1]]:
                        want[-1] = i
                else:
                    want.append(i)
        d = spark.createDataFrame([(1, f.tolist(), v.tolist())], "k int, f array<double>, v array<double>")
        assert [x["i"] for x in series.peaks(d, ["k"], "f", "v", (3.0, 60.0), 2.0).orderBy("i").collect()] == want


def test_interval_merge_and_cover(spark):
    d = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2020, 2, 1)), (1, dt.date(2020, 2, 1), dt.date(2020, 3, 1)),
                               (1, dt.date(2020, 5, 1), None), (1, dt.date(2021, 1, 1), dt.date(2021, 2, 1))], "k int, s date, e date")
    got = sorted((x["s"], x["e"] or dt.date.max) for x in temporal.merge_intervals(d, ["k"], "s", "e").collect())
    assert got == [(dt.date(2020, 1, 1), dt.date(2020, 3, 1)), (dt.date(2020, 5, 1), dt.date.max)]


def test_unified_diff_and_visible_text(spark):
    from fieldbook.sources import markup
    d = spark.createDataFrame([(1, "<p>a</p><script>x</script><p>b  c</p>", "<p>a</p><div>d</div>")], "k int, x string, y string")
    t = d.select("k", markup.visible_text("x").alias("old"), markup.visible_text("y").alias("new"))
    got = [r["line"] for r in joins.unified_diff(t, ["k"], "old", "new", 0).orderBy("pos").collect()]
    assert got == ["--- old", "+++ new", "@@ -2 +2 @@", "-b c", "+d"]


def test_hours_with_ragged_edges_count_and_gaps_do_not(spark):
    from fieldbook.operators import series
    hours = {"whole": range(20), "late": range(2, 20), "early": range(18), "long": range(21), "gap": [*range(9), *range(10, 20)],
             "short": range(17), "twice": [*range(20), 5]}
    d = spark.createDataFrame([(h, i, float(i)) for h, r in hours.items() for i in r], "h string, i int, v double").repartition(4)
    got = {r["h"]: r["trace"] for r in series.whole_hours(d, ["h"], "i", "v", 20, 2).collect()}
    assert {h: len(t) for h, t in got.items()} == {"whole": 20, "late": 18, "early": 18, "long": 20}
    assert got["late"][0] == 2.0 and got["long"][-1] == 19.0
    assert [r["h"] for r in series.whole_hours(d, ["h"], "i", "v", 20).collect()] == ["whole"]


def test_shortlists_with_equal_sizes_and_unknown_ones(spark):
    from fieldbook.operators import ranking
    r = random.Random(3)
    rows = [(i, r.choice([5.0, 5.0, 5.0, 7.0, r.random() * 20, None, 0.0]), r.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(90)]
    d = spark.createDataFrame(rows, "id int, size double, near string, far string")
    got = ranking.nearest_in_scope(d, "id", "size", {"near": "near", "far": "far"}, 3, 4)
    have = {}
    for x in got.collect():
        have.setdefault(x["target"], {})[x["place"]] = (x["peer"], x["chosen_scope"], x["size_known"])
    known = [x for x in rows if x[1]]
    import math
    for i, size, near, _ in known:
        others = [x for x in known if x[0] != i]
        scope = "near" if near and sum(x[2] == near for x in others) >= 3 else "far"
        inside = lambda x: scope == "far" or x[2] == near
        want = [(x[0], scope, True) for x in sorted((x for x in others if inside(x)), key=lambda x: (abs(math.log(x[1] / size)), x[0]))][:4]
        want += [(x[0], scope, False) for x in rows if not x[1] and inside(x)][:4 - len(want)]
        assert [have[i][k + 1] for k in range(len(want))] == want and len(have[i]) == len(want)
    assert set(have) == {x[0] for x in known}
