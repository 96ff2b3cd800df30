"""Steps that fell behind on larger tables: what they send, sort or repeat, and that their rows stay those of a plain count."""

from pyspark.sql import functions as F

from fieldbook.operators import documents, lookup, ranking, spatial, temporal
from fieldbook.plans import skew


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_and_table_rows_never_broadcast_the_rows(spark):
    cells = spark.createDataFrame([(1, -1, 0, "x"), (1, -1, 1, "rate tpy"), (1, 0, 0, "a"), (1, 0, 1, "5"), (1, 1, 0, "b"), (1, 1, 1, "7"),
                                   (2, -1, 0, "x"), (2, -1, 1, "rate tpy"), (2, 0, 0, "a"), (2, 0, 1, "5"), (2, 1, 0, "b"), (2, 1, 1, "90")],
                                  "doc long, row long, col int, text string")
    rows = documents.table_rows(cells, ["doc"], {"tpy": "TPY"})
    assert "Broadcast" not in plan_of(rows)
    assert sorted((x["doc"], x["row"], x["label"], x["TPY"]) for x in rows.collect()) == [
        (1, 0, "a", 5.0), (1, 1, "b", 7.0), (2, 0, "a", 5.0), (2, 1, "b", 90.0)]
    far = ranking.sibling_outliers(rows.withColumn("g", F.lit(1)), ["g"], "TPY", at_least=3)
    assert "Broadcast" not in plan_of(far)
    assert [(x["doc"], x["TPY"], x["sibling_median"]) for x in far.collect()] == [(2, 90.0, 6.0)]


def test_votes_skip_runs_whose_letters_cannot_agree(monkeypatch):
    met = []
    real = documents._windows
    monkeypatch.setattr(documents, "_windows", lambda *a: [met.append(1) or r for r in real(*a)])
    lines = ["the quick brown fox jumps", "zzzz zzzz zzzz zzzz zzzz zzzz", "over the lazy dog"]
    assert documents._vote(lines, ["the quick brown", "fox jumps", "over the iazy dog"]) == (["agree", "absent", "agree"], [[0, 1], [], [2]])
    assert len(met) == 1  # the exact line asks for no run, the line of other letters meets none


def _unpruned_vote(lines, units, most=12):
    import difflib
    import re
    want, runs, left = ["absent"] * len(lines), [[] for _ in lines], list(enumerate(units))
    for i in sorted((k for k in range(len(lines)) if lines[k]), key=lambda k: -len(lines[k])):
        best, span = -1, None
        for a in range(len(left)):
            for b in range(a + 1, min(a + most, len(left)) + 1):
                joined = " ".join(u for _, u in left[a:b])
                score = 100.0 * difflib.SequenceMatcher(None, lines[i], joined).ratio()
                x, y = re.sub(r"\D", "", lines[i]), re.sub(r"\D", "", joined)
                score = min(score, 89.0 if x and y and x != y else 100.0)
                if score > best:
                    best, span = score, (a, b)
        if best >= 75:
            want[i], runs[i] = "agree" if best >= 90 else "dissent", [k for k, _ in left[span[0]:span[1]]]
            del left[span[0]:span[1]]
    return want, runs


def test_votes_on_long_lines_equal_the_unpruned_search(monkeypatch):
    import difflib
    import random
    r = random.Random(9)
    words = ["".join(r.choices("eeeettaaoinshrdlucmfwypvbgkqjxz", k=r.randint(1, 9))) for _ in range(90)] + ["12", "-", "ﬁ", "ü", "日本"]
    pages = []
    for _ in range(30):
        lines = [" ".join(r.choices(words, k=r.choice([0, 3, 25, 60, 90]))) for _ in range(7)]
        units = []
        for t in lines[r.randrange(3):]:
            edit = r.choice([0.0, 0.01, 0.05, 0.15])
            t = "".join(r.choice(["", "c", ch + "."]) if r.random() < edit else ch for ch in t)
            cut = r.randrange(len(t) + 1)
            units += r.choice([[t], [t[:cut].strip(), t[cut:].strip()], [t, "", t.replace("e", "c")], []])
        pages.append((lines, units))
    want = [_unpruned_vote(*p) for p in pages]
    assert {v for w, _ in want for v in w} == {"agree", "dissent", "absent"}
    real = difflib.SequenceMatcher

    def short_only(junk, a, b):
        assert len(b) < 200
        return real(junk, a, b)
    monkeypatch.setattr(difflib, "SequenceMatcher", short_only)
    assert [documents._vote(*p) for p in pages] == want


def test_a_very_long_line_is_matched_as_published():
    import difflib
    import random
    r = random.Random(6)
    a = " ".join("".join(r.choices("eeettaoinshrdlucmfwyp", k=r.randint(1, 9))) for _ in range(700))
    for b in (a.replace("e", "c"), "".join(ch if r.random() > 0.03 else r.choice("xyz,") for ch in a), a[500:] + a[:300]):
        assert documents._similarity(a, b, 0.0) == 100.0 * difflib.SequenceMatcher(None, a, b).ratio()


def test_texts_of_a_page_are_normal_as_one_by_one(spark):
    import random

    from fieldbook.functions import text
    r = random.Random(3)
    bits = ["-", "--", "- -", "\n", "\r", "\r\n", "\t", " ", "  ", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u180e", "\u200b", "|", "┃", "│", "<TD>", "</th>",
            "<tr", "</Table>", "<table>", "ﬁ", "Straße", "12", "a", "İ", "｜", "＜td＞", ""]
    texts = ["".join(r.choices(bits, k=r.randint(0, 9))) for _ in range(3000)] + [f"a{chr(c)}{chr(c)}b" for c in range(1, 0x3100)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one = [x["n"] for x in d.select("i", text.normal_text("t").alias("n")).orderBy("i").collect()]
    assert spark.createDataFrame([(texts + [None],)], "t array<string>").select(text.normal_texts("t").alias("n")).first()["n"] == one + [None]


def test_lines_and_units_meet_by_page_in_one_grouping(spark):
    lines = spark.createDataFrame([(1, 1, "Alpha beta gamma"), (1, 1, "alpha delta"), (2, 1, None), (None, 1, "x"), (3, 1, "alone"), (1, None, "Alpha beta gamma")],
                                  "p int, line_no int, line string").repartition(5, "p")
    units = spark.createDataFrame([(1, None, 1, "alpha BETA gamma"), (1, "r", 2, None), (1, "r", 1, "alpha delta"), (2, "r", 1, "z"), (None, "r", 1, "x"), (4, "r", 1, "y")],
                                  "p int, r string, unit_no long, unit string").repartition(5, "p")
    got = documents.reader_votes(lines, units, ["p"], "r")
    assert plan_of(got).count("Exchange") == 2  # those of the callers
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, [
        (1, None, None, "agree", 0, "alpha BETA gamma"), (1, None, 1, "absent", None, None), (1, None, 1, "absent", None, None),
        (1, "r", None, "absent", None, None), (1, "r", 1, "absent", None, None), (1, "r", 1, "agree", 0, "alpha delta"), (2, "r", 1, "absent", None, None)]))


def test_cases_of_a_common_company_meet_without_travelling(spark):
    items = spark.createDataFrame([(i, f"Case 2024-{i}-CUP by Delta Works") for i in range(6)] + [(3, "delta works again"), (None, "case 2024-2-cup")],
                                  "i int, t string")
    cases = spark.createDataFrame([(c, f"rezoning 2024-{c}-CUP for Delta Works, LLC") for c in range(4)], "c int, title string")
    got = documents.track_cases(items, "i", "t", cases, "c", "title")
    want = {(i, c): 1 + (i == c) + (i == 3) for i in range(6) for c in range(4)} | {(None, 2): 1}
    assert {(x["i"], x["c"]): x["keys"] for x in got.collect()} == want
    assert "array_intersect" in plan_of(got)
    import pytest
    with pytest.MonkeyPatch.context() as m:
        m.setattr(documents, "WIDE_ITEM", 1)
        again = documents.track_cases(items, "i", "t", cases, "c", "title")
        assert {(x["i"], x["c"]): x["keys"] for x in again.collect()} == want


def test_marks_tell_cases_that_share_one_key(spark):
    import random
    r = random.Random(4)
    own = {c: {f"{2000 + r.randrange(30)}-{r.randrange(4)}-CUP" for _ in range(r.choice([1, 2, 3, 90]))} for c in range(40)}
    held = {i: {f"{2000 + r.randrange(30)}-{r.randrange(4)}-CUP" for _ in range(r.choice([0, 1, 2, 80]))} for i in range(40)}
    rows = lambda d: [(k, " and ".join(sorted(v))) for k, v in d.items()]
    got = documents.track_cases(spark.createDataFrame(rows(held), "i int, t string"), "i", "t", spark.createDataFrame(rows(own), "c int, title string"),
                                "c", "title")
    assert {(x["i"], x["c"], x["keys"]) for x in got.collect()} == {
        (i, c, len(h & o)) for i, h in held.items() for c, o in own.items() if h & o} and got.count() == len(got.distinct().collect())
    join = next(x for x in plan_of(got).split("\n") if "SortMergeJoin" in x and "__held" in x)
    assert join.index("__h1") < join.index("array_intersect") and join.count("array_intersect") == 1  # marks first, lists for the rest


def test_distance_bands_fold_before_they_travel(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_FOLD_ROWS", 3)
    d = spark.createDataFrame([("a", float(i) / 2) for i in range(9)] + [("a", 0.0), ("b", None), (None, 7.25)], "k string, d double")
    got = spatial.distance_bands(d, ["k"], "d", [1.0, 2.5], 3)
    assert "Window" not in plan_of(got) and "MapInArrow" in plan_of(got)
    assert {tuple(x) for x in got.collect()} == {("a", 10, 2, 4, 7, "0.000, 0.000, 0.500"), ("b", 1, 0, 0, 0, ""), (None, 1, 0, 0, 0, "7.250")}
    assert tuple(spatial.distance_bands(d, [], "d", [1.0], 2).first()) == (12, 2, 4, "0.000, 0.000")


def test_bands_counted_where_they_meet_equal_all_pairs(spark, monkeypatch):
    import random

    from fieldbook.functions import geo
    r = random.Random(11)
    spots = [(r.uniform(-89.5, 89.5), r.uniform(-180, 180)) for _ in range(60)] + [(30 + r.gauss(0, 0.1), -91 + r.gauss(0, 0.1)) for _ in range(200)]
    spots += [(10 + r.uniform(-1, 1), r.choice([179.6, -179.9]) + r.uniform(0, 0.3)) for _ in range(40)] + [(30.0, -91.0)] * 40
    spots += [(10.0, 180.0), (10.0, -180.0), (89.9, 0.0), (89.9, 180.0), (-89.9, -170.0), (None, 3.0), (3.0, None), (float("nan"), 5.0), (5.0, float("nan"))]
    l = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "a int, lat double, lon double")
    q = spark.createDataFrame([(i % 150 or None, *p, {i: i}) for i, p in enumerate(spots[::-1] + spots[:20])], "b int, rlat double, rlon double, m map<int,int>")
    monkeypatch.setattr(spatial, "_COUNTED_ROWS", 7)
    monkeypatch.setattr("fieldbook.operators.rings._AT_ONCE", 50)
    for radius, edges in ((30.0, [0.0, 5.0, 30.0]), (400.0, [100.0, 250.5, 500.0])):
        every = l.crossJoin(q.drop("m")).withColumn("d", geo.haversine("lat", "lon", "rlat", "rlon")).where(f"d <= {radius} and not isnan(d)")
        want = sorted(map(str, spatial.distance_bands(every, ["b"], "d", edges, 3).collect()))
        met = spatial.radius_join(l, q, radius, salt_by=["a"], rows_per_split=50, bands=edges, nearest=3, out="d")
        assert met.columns == ["b", "rlat", "rlon", "m", "d"] and "lon" not in met.columns
        assert sorted(map(str, spatial.distance_bands(met, ["b"], "d", edges, 3).collect())) == want
    import pytest
    with pytest.raises(Exception, match="within_7|FIELD_NOT_FOUND"):
        spatial.distance_bands(met, ["b"], "d", [7.0], 3)


def test_band_counts_measure_few_places(monkeypatch):
    import numpy as np

    from fieldbook.operators import rings
    g = np.random.default_rng(2)
    lat, lon, y, x = 30 + g.uniform(0, 0.3, 20_000), -91 + g.uniform(0, 0.3, 20_000), 30 + g.uniform(0, 0.3, 50), -91 + g.uniform(0, 0.3, 50)
    measured, real = [], rings.Places.distance
    monkeypatch.setattr(rings.Places, "distance", lambda self, at, *a: (measured.append(len(at)), real(self, at, *a))[1])
    sums, _ = rings.tally(y, x, np.zeros(50), rings.Places(lat, lon, 3958.8), 20.0, [5.0, 10.0], 5)
    assert sums[0].sum() > 500_000 > 6 * sum(measured)


def test_a_common_surname_is_met_in_several_tasks(spark, monkeypatch):
    f = spark.createDataFrame([(i, "Smith", "Ann" if i % 2 else "") for i in range(60)], "i int, last string, first string")
    p = spark.createDataFrame([(j, "Anna Smith") for j in range(50)], "j int, person string")
    monkeypatch.setattr(lookup.salted_join, "__defaults__", ("inner", 100_000, 200))
    got = lookup.name_grades(f, p, "last", "first", "person")
    assert got.columns == ["i", "last", "first", "j", "person", "match"]
    assert got.groupBy("match").count().orderBy("match").collect() == [("first and last", 1500), ("last name only", 1500)]
    assert got.select(F.spark_partition_id()).distinct().count() > 3


def test_pairs_set_the_number_of_tasks(spark):
    l, r = spark.range(0, 400).selectExpr("id % 20 k", "id a"), spark.range(0, 400).selectExpr("id % 20 k", "id b")
    assert skew.pair_count(l, r, ["k"]) == 8000
    got = skew.salted_join(l, r, ["k"], ["a"], pairs_per_split=500)
    assert got.rdd.getNumPartitions() >= 16 and got.distinct().count() == got.count() == 8000


def test_peaks_after_events_form_no_pairs(spark):
    import random
    random.seed(5)
    ts = lambda: random.choice([0, 3600, 7200, 10800]) + random.randint(0, 6) * 300
    ev = [(i % 40, i % 3 or None, ts()) for i in range(60)] + [(77, 1, None)]
    rd = [(random.choice([0, 1, 2, None]), ts(), random.choice([None, 1.0, 2.0, 3.0])) for _ in range(90)]
    e = spark.createDataFrame(ev, "id int, k int, s long").selectExpr("id", "k", "timestamp_seconds(s) t")
    r = spark.createDataFrame(rd, "k int, s long, v double").selectExpr("k", "timestamp_seconds(s) rt", "v", "s c")
    got = temporal.peak_after(e, r, ["k"], "id", "t", "rt", "v", ["c"], 3600)
    assert "max_by" not in plan_of(got)  # which sorts all the pairs
    met = {}
    for i, k, t in ev:
        for kk, s, v in rd:
            if None not in (k, t, kk, v) and k == kk and t <= s <= t + 3600:
                met.setdefault(i, []).append((v, t - s, s))
    want = sorted((i, len(met.get(i, ())), *((m[0], -m[1], m[2]) if (m := max(met.get(i, ()), default=None)) else (None,) * 3)) for i, _, _ in ev)
    assert sorted((x["id"], x["readings"], x["peak"], x["lag_s"], x["c"]) for x in got.collect()) == want


def test_nearest_starts_where_few_places_lie(spark):
    far = spark.range(0, 3000).selectExpr("id j", "30 + (id * 7919 % 3001) / 3000 rlat", "-90 + (id * 104729 % 2999) / 2999 rlon")
    steps = spatial._widening(far, ("rlat", "rlon"), 30.0, 3958.7613)
    assert steps[-1] == 1.0 and steps[0] < 0.25 and 3000 * 3.15 * (30.0 * steps[0]) ** 2 < 20 * 70 * 60
    l = spark.createDataFrame([(0, 30.5, -89.5), (1, 30.2, -89.1), (2, 45.0, -89.5)], "i int, lat double, lon double")
    near = {x["i"]: (x["j"], x["distance"]) for x in spatial.nearest_join(l, far.union(far), "i", ["j"], 30.0).collect()}
    once = {x["i"]: (x["j"], x["distance"]) for x in spatial.nearest_join(l, far, "i", ["j"], 30.0, steps=[1.0]).collect()}
    assert near == once and near[2] == (None, None) and near[0][1] < 30
