"""The Jaccard join against counted overlaps."""

import random

import brute
from pyspark.sql import types as T

from fieldbook.llm import jaccard

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n", T.StringType()), T.StructField("key", T.StringType())])


def _run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(df).collect()}


def test_near_copies_short_sets_and_shared_passages(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(220)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for i in range(60):  # copies with 0 to 8 changed words, some on either side of the limit
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(60, 120):  # a common passage in texts that are otherwise their own
        rows.append((i, " ".join(rnd.choice(words) for _ in range(90)) + " " + passage))
    for i in range(120, 200):  # short sets of few words
        rows.append((i, " ".join(rnd.choice(words[:4]) for _ in range(rnd.randrange(1, 14)))))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two  THREE"), (204, "one Two three "), (205, "one two three four"),
             (206, "a b c d e f g h"), (207, "A B c d e f g h i"), (208, "Été été x y z   q"), (209, "x " * 3000)]
    assert _run(spark, rows) == brute.jaccard_components(rows)


def test_empty_table_and_repeated_rows(spark):
    assert _run(spark, []) == {}
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in jaccard.link_components(df).fillna(-1, ["id"]).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3)]
    alone = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in jaccard.link_components(alone).collect()] == [(None, 0, None)]


def test_every_boundary_gives_the_same_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 20)))) for i in range(150)]
    want = brute.jaccard_components(rows)
    chosen = jaccard.choose_boundary
    try:
        for x in (0, 6, 12, 50):
            jaccard.choose_boundary = lambda classes, x=x: x
            assert _run(spark, rows) == want, x
    finally:
        jaccard.choose_boundary = chosen


def test_star_rounds_end_when_they_gain_little(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(300)}" for _ in range(150)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1:])) for i, k in enumerate(rnd.sample(range(150), 40))]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, " ".join(f"v{rnd.randrange(900)}" for _ in range(15)) + " " + passage) for i in range(30)]
    turns, star = [], jaccard._star
    monkeypatch.setattr(jaccard, "_star", lambda m, c, turn, p: (turns.append(turn), star(m, c, turn, p).orderBy("a", "b").limit(1))[1])
    assert _run(spark, rows) == brute.jaccard_components(rows)
    assert turns == [0]


def test_nothing_is_paired_when_the_stars_leave_no_pair(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("paired")

    rnd = random.Random(5)
    base = [f"w{rnd.randrange(300)}" for _ in range(150)]
    rows = [(i, " ".join(base[:9 * i] + [f"own{i}"] + base[9 * i + 1:])) for i in range(12)]
    rows += [(50 + i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(5)]
    monkeypatch.setattr(jaccard, "salted_join", refuse)
    assert _run(spark, rows) == brute.jaccard_components(rows)
