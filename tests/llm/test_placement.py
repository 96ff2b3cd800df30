"""Shards under quotas, ends of account numbers, repeated ids in the pipeline."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import pii, sharding

DOCS = "doc_id long, text string, source string, shard string, link string, n long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "s", "l", 9) for i, t in rows], DOCS)


def _parted(placed, link):
    kept = placed[placed[link].notna()].groupby(link)["shard"].nunique()
    return (kept > 1).sum()


def _even(placed, shards):
    sizes = placed["shard"].value_counts().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, g in placed.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_every_document_has_a_partner(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2000).alias("k"))
    got = sharding.place(df, "k").toPandas()
    _even(got, 16)
    assert _parted(got, "k") <= 100


def test_a_link_of_a_third_of_all_rows_and_pairs_around_it(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(sharding, "ROWS_PER_CHUNK", 400)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, -1).otherwise(F.col("id") % 1000).alias("k"))
    got = sharding.place(df, "k", 8).toPandas()
    _even(got, 8)
    pairs = got[got["k"] >= 0]
    assert _parted(pairs, "k") <= 50
    assert got[got["k"] == -1]["shard"].value_counts().max() >= 300


def _cut(shards, edges):
    return sum(shards[a] != shards[b] for a, b in edges)


def test_small_graphs_against_all_even_placements(spark):
    """Rows in order of columns a and b: two links a row. The cut is near the least one and far below the mean one."""
    for seed in range(2):
        rnd = random.Random(seed)
        rows = [(i, i // 4, rnd.randrange(3) if i % 4 == 0 else None) for i in range(12)]
        edges = [(x[0], y[0]) for x, y in itertools.combinations(rows, 2) for c in (1, 2) if x[c] is not None and x[c] == y[c]]
        cuts = []
        for left in itertools.combinations(range(12), 6):
            cuts.append(_cut([i in left for i in range(12)], edges))
        placed = sharding.place(spark.createDataFrame(rows, "doc_id long, a long, b long"), ["a", "b"], 2).toPandas()
        _even(placed, 2)
        got = _cut(dict(zip(placed["doc_id"], placed["shard"])), edges)
        told = sharding.cut_links(spark.createDataFrame(placed), ["a", "b"]).agg(F.sum("cut")).first()[0] if len(placed) else 0
        assert int(told or 0) == got
        assert min(cuts) <= got <= (min(cuts) + sum(cuts) / len(cuts)) / 2 + 1


def test_requests_are_granted_within_room():
    share = sharding.granted({(0, 1): 10, (1, 0): 4, (2, 1): 6}, [0, 6, 0])
    assert share[1, 0] == 1 and share[0, 1] == pytest.approx(.7) and share[2, 1] == pytest.approx(.5)
    assert sharding.granted({(0, 1): 5}, [0, -3]) == {(0, 1): 0.0}


def test_empty_null_and_clashing_columns(spark):
    assert sharding.place(_docs(spark, []), ["text", "link"]).collect() == []
    got = sharding.place(_docs(spark, [(1, None), (1, "long " * 50_000), (None, ""), (2, None)]), "text", 3)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "shard", "link", "n", "slot"])
    assert got.count() == 4 and got.select("shard").distinct().count() == 3


def test_account_numbers_end_where_their_digits_check(spark):
    texts = ["bank DE89370400440532013000 Please pay", "iban DE89 3704 0044 0532 0130 00 AND more", "iban GB29 NWBK 6016 1331 9268 19 THIS WAS",
             "IBAN DE89370400440532013000 GB29NWBK60161331926819 ok", "iban DE88370400440532013000", "iban xDE89370400440532013000"]
    want = [["DE89370400440532013000"], ["DE89 3704 0044 0532 0130 00"], ["GB29 NWBK 6016 1331 9268 19"],
            ["DE89370400440532013000", "GB29NWBK60161331926819"], [], []]
    got = {r["doc_id"]: [m["value"] for m in r["pii"] if m["kind"] == "iban"] for r in pii.find(_docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_context_is_read_across_pieces(spark):
    number = "+4912345678"
    texts = ["😀" * k + "call " + number + " " + "y" * 60 for k in (0, 460, 470, 500, 505, 511, 512, 1020)]
    texts += ["z" * k + number + " fax" for k in (490, 498, 500, 501, 512)] + ["call " + "z" * 40 + number, number]
    got = {r["doc_id"]: r["pii"] for r in pii.find(_docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i][0]["score"] for i in range(len(texts))] == [0.8] * (len(texts) - 2) + [0.5] * 2
    assert all(m["value"] == texts[i][m["start"]:m["end"]] == number for i, (m,) in got.items())


def test_time_grows_with_the_matches(spark):
    def seconds(n):
        df = _docs(spark, [(1, " ".join(f"10.0.{i % 256}.7 x" for i in range(n)))])
        t = time.time()
        assert pii.find(df).select(F.size("pii")).first()[0] == n
        return time.time() - t
    seconds(1000)
    assert seconds(40_000) < 2.5 * seconds(20_000) + 1


def test_rows_that_repeat_an_id_stay_if_their_texts_differ(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (3, b), (3, c), (3, c), (4, b), (5, ""), (6, None), (None, a), (7, "x " * 100_000)]
    got = corpus_pipeline.one_of_each_group(spark, _docs(spark, rows), "")
    assert got.columns == _docs(spark, []).columns
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum(t == c for _, t in texts) == 1 and sum(t == b for _, t in texts) == 1
    assert (1, a) in texts and (None, a) in texts and not any(i == 2 for i, _ in texts)
    assert {5, 6, 7} <= {i for i, _ in texts} and len(texts) == 7
    plain = corpus_pipeline.one_of_each_group(spark, _docs(spark, rows[:2]), "")
    assert [r["doc_id"] for r in plain.collect()] == [1]
    assert corpus_pipeline.one_of_each_group(spark, _docs(spark, []), "").collect() == []
