"""Plan shapes give the same rows as the plain form, whatever the skew and the partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldbook.plans import ordered
from fieldbook.plans.quantiles import exact_quantiles
from fieldbook.plans.skew import block_counts, salted_join


@pytest.fixture(params=[1_000_000, 7])
def chunk_rows(request, monkeypatch):
    """Once with one chunk per key, once with keys cut every few rows."""
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", request.param)
    return request.param


def rows(spark, n=400, seed=3):
    r = random.Random(seed)
    data = []
    for i in range(n):
        key = None if r.random() < 0.05 else 0 if r.random() < 0.4 else r.randrange(12)
        data.append((key, r.randrange(10_000), i, r.choice([None, r.uniform(-5, 5)])))
    return spark.createDataFrame(data, "k int, t long, id int, v double")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_previous_and_next(spark, chunk_rows):
    d = rows(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    same(ordered.with_previous(d, ["k"], ["t", "id"], ["v", "id"]).select("id", "prev.v", F.col("prev.id").alias("p")),
         d.select("id", F.lag("v").over(w).alias("v"), F.lag("id").over(w).alias("p")))
    same(ordered.with_next(d, ["k"], ["t", "id"], ["id"]).select("id", F.col("next.id").alias("n")),
         d.select("id", F.lead("id").over(w).alias("n")))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, chunk_rows, inclusive):
    d = rows(spark).withColumn("i", F.col("id").cast("long"))
    got = ordered.running(d, ["k"], ["t", "id"], None, {
        "s": ("sum", "i"), "m": ("max", "v"), "l": ("last", "v"), "f": ("first_next", "v")}, inclusive)
    w = Window.partitionBy("k").orderBy("t", "id")
    b = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    a = w.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    want = d.select("id", F.sum("i").over(b).alias("s"), F.max("v").over(b).alias("m"), F.last("v", True).over(b).alias("l"),
                    F.first("v", True).over(a).alias("f"))
    same(got.select("id", "s", "m", "l", "f"), want)


def test_running_without_keys(spark, chunk_rows):
    d = rows(spark).withColumn("i", F.col("id").cast("long"))
    got = ordered.running(d, [], ["t", "id"], None, {"s": ("sum", "i")}).select("id", "s")
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(got, d.select("id", F.sum("i").over(w).alias("s")))


def test_partition_count_does_not_matter(spark, chunk_rows):
    d = rows(spark)
    f = lambda x: ordered.with_previous(x, ["k"], ["t", "id"], ["id"]).select("id", F.col("prev.id").alias("p"))
    same(f(d.repartition(1)), f(d.repartition(7)))


def test_hot_keys_are_cut_and_others_are_not(spark):
    d = rows(spark)
    c = ordered.add_chunks(d, ["k"], "t", rows=20).groupBy("k").agg(F.countDistinct("__ck").alias("n")).collect()
    by = {r["k"]: r["n"] for r in c}
    assert by[0] > 5
    assert min(by.values()) == 1 or min(by.values()) < by[0]


def test_outliers_leave_chunks_even(spark):
    r = random.Random(9)
    value = lambda: r.choice([-2_208_988_800, 253_402_300_799]) if r.random() < 0.01 else 1_700_000_000 + r.randrange(10**6)
    d = spark.createDataFrame([(0 if i % 3 == 0 else i, value(), i) for i in range(9000)], "k int, t long, id int")
    for keys, hot in ((["k"], "k = 0"), ([], "true")):  # no single value has as many rows as a chunk
        c = ordered.add_chunks(d, keys, "t", rows=100).where(hot).groupBy("__ck").agg(
            F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("__ck").collect()
        assert len(c) > 25 and max(x["n"] for x in c) < 200
        assert all(a["hi"] < b["lo"] for a, b in zip(c, c[1:]))


def test_rank_of_all_rows(spark):
    d = rows(spark)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    same(ordered.rank_all(d, order).select("id", "rank"),
         d.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank")))


def test_quantile_brackets_with_heavy_repeats(spark):
    data = [(float(i),) for i in range(2000)] + [(float(h),) for h in (10, 500, 900, 1500, 1990) for _ in range(3000)]
    d = spark.createDataFrame(data, "x double").repartition(4)
    got = exact_quantiles(d, [], "x", [0.1, 0.5, 0.9], ["a", "b", "c"]).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(np.quantile([x for x, in data], [0.1, 0.5, 0.9]).tolist())


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, p):
    rng = np.random.default_rng(5)
    groups = {0: rng.exponential(size=900), 1: np.repeat([3.0, 4.0], [1, 60]), 2: np.array([7.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(1, None), (2, float("nan"))]
    d = spark.createDataFrame(data, "g int, x double").repartition(5)
    for accuracy in (2000, 3):  # a coarse sketch must not change the answer
        got = {r["g"]: (r["q"], r["n"]) for r in exact_quantiles(d, ["g"], "x", [p], ["q"], accuracy=accuracy).collect()}
        for g, xs in groups.items():
            assert got[g][0] == pytest.approx(np.quantile(xs, p), rel=1e-12)
            assert got[g][1] == len(xs)
        up = {r["g"]: r["q"] for r in exact_quantiles(d, ["g"], "x", [0.5], ["q"], upper=True, accuracy=accuracy).collect()}
        for g, xs in groups.items():
            assert up[g] == sorted(xs)[len(xs) // 2]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    l = spark.createDataFrame([(i % 3 if i % 5 else 0, i) for i in range(200)] + [(None, 999), (77, 1000)], "k int, a int")
    r = spark.createDataFrame([(i % 4, i) for i in range(20)], "k int, b int")
    got = salted_join(l, r, ["k"], ["a"], how, rows_per_split=10).select("k", "a", "b")
    same(got, l.join(r, "k", how).select("k", "a", "b"))


def test_salted_join_spreads_either_side_and_both(spark):
    for nl, nr in ((400, 3), (3, 400), (120, 90), (1, 1)):
        l = spark.createDataFrame([("hot", i, None) for i in range(nl)] + [("a", 1000, 1), ("b", 1001, 2), (None, 1002, 3)], "k string, a int, x int")
        r = spark.createDataFrame([("hot", i, [i]) for i in range(nr)] + [("a", 5, [1]), ("a", 5, [1]), ("c", 6, None), (None, 7, None)],
                                  "k string, b int, y array<int>")
        got = salted_join(l, r, ["k"], ["a"], rows_per_split=50, pairs_per_split=900)
        same(got.select("k", "a", "x", "b", "y"), l.join(r, "k").select("k", "a", "x", "b", "y"))
        c = block_counts(l, r, ["k"], 50, 900).collect()
        if nl * nr > 900:
            (h,) = c
            assert nl / h["__ls"] <= 50 and nr / h["__rs"] <= 50 and nl * nr / (h["__ls"] * h["__rs"]) <= 900
            per = {}  # pairs that one task makes, as the join deals them
            lb = l.where("k = 'hot'").select(F.pmod(F.xxhash64("a"), F.lit(h["__ls"])).alias("b")).groupBy("b").count().collect()
            per = max(x["count"] for x in lb)
            assert h["__ls"] == 1 or per < nl / 2
        else:
            assert c == []


def test_a_hot_cell_of_right_points_is_spread(spark):
    from fieldbook.operators.spatial import radius_join
    l = spark.createDataFrame([(i, 30.0 + i / 1000, -90.0) for i in range(4)], "i int, lat double, lon double")
    r = spark.createDataFrame([(j, 30.0 + (j % 50) / 10000, -90.0) for j in range(600)], "j int, rlat double, rlon double")
    plain = radius_join(l, r, 0.5).select("i", "j")
    same(radius_join(l, r, 0.5, rows_per_split=40).select("i", "j"), plain)
    assert plain.count() > 1000


def test_components_of_stars_need_no_round(spark, monkeypatch):
    from fieldbook.operators import graph
    cut, plain = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: (cut.append(1), plain(df))[1])
    nodes = spark.range(12).withColumn("id", F.col("id").cast("int"))
    stars = spark.createDataFrame([(3, 0), (0, 4), (5, 0), (0, 5), (9, 7), (8, 8)], "a int, b int")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, stars).collect()}
    assert got == {i: {3: 0, 4: 0, 5: 0, 9: 7}.get(i, i) for i in range(12)} and len(cut) == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(None, 11), (11, None)], "a int, b int")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, path).collect()}
    assert got == {i: 0 for i in range(11)} | {11: 11}
