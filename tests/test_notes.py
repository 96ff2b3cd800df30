"""Typed counts, page selections, straddling parcels, comparable windows: known answers."""

import datetime as dt

from fieldbook.operators import documents, graph, lookup, rollups, series, temporal


def test_counts_typed_as_text(spark):
    rows = [("a", "3"), ("a", " 4 "), ("a", "several"), ("a", ""), ("a", None), ("a", "2.5"), ("b", None), (None, "+1"), ("a", "9" * 30)]
    got = {r["k"]: r for r in rollups.tolerant_totals(spark.createDataFrame(rows, "k string, hurt string"), ["k"], ["hurt"]).collect()}
    assert (got["a"]["reports"], got["a"]["hurt"], got["a"]["with_hurt"], got["a"]["unreadable_hurt"]) == (7, 7, 5, 3)
    assert (got["b"]["hurt"], got["b"]["with_hurt"], got["b"]["unreadable_hurt"]) == (0, 0, 0) and got[None]["hurt"] == 1


def test_shares_of_areas(spark):
    rows = [(1, "x", 1.0), (1, "y", 7.0), (1, "x", 0.0), (2, None, 4.0), (3, "x", 0.0)]
    got = {(r["p"], r["area"]): (r["percent"], r["place"]) for r in
           rollups.area_shares(spark.createDataFrame(rows, "p long, area string, w double"), ["p"], "area", "w").collect()}
    assert got == {(1, "y"): (88, 1), (1, "x"): (12, 2), (2, None): (100, 1), (3, "x"): (None, 1)}


def test_pages_to_send(spark):
    rows = [("some", p, p in (4, 9)) for p in range(1, 21)] + [("none", p, False) for p in (1, 2)] + [("whole", p, p == 2) for p in (1, 2, 3, 4)]
    got = {r["doc"]: r for r in documents.page_selection(spark.createDataFrame(rows, "doc string, page long, t boolean"), ["doc"], "page", "t").collect()}
    assert (got["some"]["spec"], got["some"]["selected"], got["some"]["advice"]) == ("3-5,8-10", 6, "pages")
    assert (got["none"]["spec"], got["none"]["pages"], got["none"]["advice"]) == ("", 2, "none")
    assert (got["whole"]["spec"], got["whole"]["flagged"], got["whole"]["advice"]) == ("1-3", 1, "whole")
    alone = documents.page_selection(spark.createDataFrame(rows, "doc string, page long, t boolean"), ["doc"], "page", "t", neighbours=False)
    assert {r["doc"]: r["spec"] for r in alone.collect()} == {"some": "4,9", "none": "", "whole": "2"}


def test_parts_of_a_parcel_that_lie_apart(spark):
    rows = [(1, 10, "A", 5.0), (2, 10, "B", 9.0), (3, 20, "B", 50.0), (4, 20, "C", 60.0), (5, 30, None, 70.0), (6, 10, None, 8.0)]
    got = {r["id"]: (r["kept"], r["detached"]) for r in graph.nearest_group(
        spark.createDataFrame(rows, "id long, component long, pin string, d double"), "component", "pin", "d").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (False, False), 6: (True, False)}


def test_windows_that_share_no_month(spark):
    at = lambda m, h: dt.datetime(2024, m, 1, h, 30)
    schema = "k string, ts timestamp"
    before = spark.createDataFrame([("a", at(1, 0)), ("a", at(1, 0)), ("a", at(2, 1)), ("b", at(1, 0))], schema)
    after = spark.createDataFrame([("a", at(2, 3)), ("b", at(3, 3)), ("c", at(3, 3))], schema)
    got = {r["k"]: r for r in series.window_notes(before, after, ["k"], "ts", (4, 3)).collect()}
    assert (got["a"]["hours_before"], got["a"]["shared_months"], got["a"]["no_shared_month"], got["a"]["thin_before"], got["a"]["thin_after"]) == \
        (2, 1, False, False, True)
    assert got["b"]["no_shared_month"] and got["c"]["hours_before"] == 0 and got["c"]["thin_before"]


def test_refraction_and_documents(spark):
    rows = [("x", 0.0, 340.0), ("x", 180.0, 343.0), ("x", 220.0, 330.0), ("y", 0.0, 340.0), ("z", 10.0, 340.0), ("z", 300.0, 338.0)]
    got = {r["p"]: (r["low_z"], r["top_z"], r["delta"], r["refraction"]) for r in temporal.refraction(
        spark.createDataFrame(rows, "p string, z double, c double"), ["p"], "z", "c", 200.0).collect()}
    assert got == {"x": (0.0, 180.0, 3.0, "downward"), "y": (0.0, None, None, None), "z": (10.0, 300.0, -2.0, "upward")}
    rec = spark.createDataFrame([("d", 2, "s"), ("d", 2, "s"), ("d", 2, "r"), ("d", 1, "s"), ("e", 9, None)], "key string, doc long, src string")
    out = {(r["key"], r["place"]): (r["doc"], r["src"]) for r in lookup.docket_documents(rec, "key", "doc", "src").collect()}
    assert out == {("d", 1): (1, "s"), ("d", 2): (2, "r"), ("d", 3): (2, "s"), ("e", 1): (9, None)}
