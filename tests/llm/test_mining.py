"""Hard negatives, secrets by inferred grammars, and phrases from subtrees, against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import hard_negatives, phrases, secret_grammar
from fieldbook.llm.common import Workspace

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, rank string"


def _mined(spark, rows, **more):
    df = spark.createDataFrame([(i, e, lb, 1, "v", "r") for i, lb, e in rows], VECTORS)
    got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 400])
def test_hard_negatives_match_a_full_scan(spark, anchor_bytes):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(4, 11))
    rows = []
    for i in range(400):
        e = (centres[i % 4] * (i % 3 > 0) + 0.4 * rnd.normal(size=11)).astype(np.float32)
        rows.append((i, int(rnd.integers(3)), [round(float(x), 1) for x in e]))
    rows += [(400 + i, i % 2, rows[5][2]) for i in range(60)]  # one vector many times
    rows += [(470, 1, [0.0] * 11), (480, 7, rows[8][2]), (490, 0, [0.0] * 11)]
    odd = [(500, None, [1.0] * 11), (510, 1, None), (520, 1, [None] + [1.0] * 10), (530, 1, [float("nan")] * 11),
           (540, 1, [float("inf")] * 11), (550, 1, [1.0] * 3), (560, 1, []), (None, 1, [1.0] * 11)]
    whole = [(i, lb, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, lb, e in rows]
    got = _mined(spark, rows + odd, anchor_bytes=anchor_bytes)
    want = brute.hard_negatives(whole, {i for i, *_ in rows if i % 10 == 0})
    assert got == want and len(want) > 300


def test_hard_negatives_of_few_huge_and_no_rows(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [-1.0])]) == []
    assert _mined(spark, [(0, 1, [1e30, 0.0]), (1, 1, [1e30, 0.0]), (2, 2, [1e9, 0.0])]) == [(0, 1, 1, 2, 1 << 48, 1 << 48)]
    twice = [(10, 1, [1.0]), (10, 1, [1.0]), (11, 1, [1.0]), (12, 2, [1.0]), (12, 2, [1.0])]
    assert _mined(spark, twice) == [(10, 11, 1, 12, 65536, 65536), (10, 11, 2, 12, 65536, 65536)]


DOCS = "doc_id long, text string, lang string, key string, id long, base string, n long, word string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 4, "b", 9, "w") for i, t, lang in rows], DOCS)


def _secret_rows():
    rnd = random.Random(4)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    word = lambda: pick("aehinorst", rnd.randrange(2, 12))
    rows = []
    for i in range(300):
        t = " ".join(word() for _ in range(30))
        t += rnd.choice([f' token = "{pick("0123456789abcdef", 40)}"', f" AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)} x",
                         f" PassWord={pick('0123456789abcdef', 16)}.", " api_key : 'short'", " secret=token=abcdefghijk1", ""])
        rows.append((i, "é😀 " * (i % 3) + t, "en"))
    rows += [(900, None, None), (901, "", None), (902, "AKIA" + "A" * 13, "x"), (903, "AKIAAKIA" + "Z9" * 6, "x"), (904, "a" * 15, "x"),
             (905, "0123456789abcdef" * 9000 + " token" * 5000, "x"), (906, "tok\nen=abcdefghijklmno", "x"), (907, "toKen=abcdefghijklmno", "x"),
             (907, "password:abcdefghijkl", "x"), (None, "deadbeefdeadbeef", "x"), (908, "xapikey=password=secret:aaaaaaaaaaaaaa", "x"),
             (909, "key ghp_" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36) + " end", "x"),
             (910, "use sk_live_" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24) + ".", "x"),
             (911, "version-2-of-the-third-report in mail7.example.com/path_2024 and 1234567890-0987654321", "x")]
    return rows


def test_secrets_of_the_patterns_and_of_the_automata(spark):
    rows = _secret_rows()
    got = secret_grammar.find(_docs(spark, rows)).collect()
    plain = lambda r, c: [(s["kind"], s["start"], s["end"]) for s in r[c]]
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted([(r["id"], plain(r, "base")) for r in got], key=key) == sorted([(i, brute.secrets(t)) for i, t, _ in rows], key=key)
    more = {r["id"]: [s for s in r["spans"] if s["score"] is not None] for r in got}
    assert [(s["kind"], s["start"]) for s in more[909]] == [("like_code_host", 4)]
    assert [(s["kind"], s["end"]) for s in more[910]] == [("like_payments", 4 + 8 + 24)]
    assert not more[911] and not any(more[i] for i in range(300))
    assert all(plain(r, "base") == [s for s in plain(r, "spans") if not s[0].startswith("like_")] for r in got)
    assert secret_grammar.find(_docs(spark, [])).collect() == []


def test_inferred_automaton_tells_its_format_apart():
    rnd = random.Random(8)
    make = lambda: "K" + "".join(rnd.choice("01") for _ in range(6)) + "-" + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(2, 5)))
    a = secret_grammar.infer([make() for _ in range(800)])
    again = secret_grammar.infer(["ab" * 3] * 5)
    assert len(a.steps) < 60 and again.likelihood("ababab") > again.likelihood("ab")
    good = min(a.likelihood(make()) for _ in range(50))
    assert good > max(a.likelihood(x) for x in ("K010101xyz", "010101-xy", "Kxyzxyz-01", "K01a101-xy"))
    assert a.likelihood("") < good


def _phrase_rows(n=260):
    rnd = random.Random(5)
    words = ["the", "of", "New", "York", "city", "a", "über", "straße", "x.y", "in"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 8, 8, 6, 15, 4, 4, 2, 9] + [2] * 40
    rows = []
    for i in range(n):
        w = rnd.choices(words, weights, k=rnd.randrange(60))
        t = "".join(x + rnd.choice([" ", " ", " ", "\t ", ", ", "\n", "! ", "  "]) for x in w)
        rows.append((i, t, rnd.choice(["en", "en", "fr", None, ""])))
    rows += [(i, "hot hot hot hot hot New York city", "en") for i in range(n)]
    rows += [(1, None, "en"), (2, "", None), (3, "one two three " * 3000, "xx"), (4, "rare", "yy"), (None, "New York city", "und")]
    return rows


@pytest.mark.parametrize("budget", [100_000, 900, 40])
def test_phrases_at_every_budget(spark, budget):
    rows = _phrase_rows()
    got = phrases.collocations(_docs(spark, rows).repartition(5), top=60, budget=budget).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"])):
        have.setdefault(r["lang"], []).append(tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")))
        assert r["rank"] == len(have[r["lang"]])
    assert have == brute.collocations([(lang, t) for _, t, lang in rows], top=60)


def test_phrases_whose_words_are_looked_up_by_shuffles(spark, monkeypatch):
    rows = _phrase_rows()
    monkeypatch.setattr(phrases, "small", lambda df, *_: df)
    have = {}
    for r in sorted(phrases.collocations(_docs(spark, rows), top=60).collect(), key=lambda r: (r["lang"], r["rank"])):
        have.setdefault(r["lang"], []).append(tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")))
    assert have == brute.collocations([(lang, t) for _, t, lang in rows], top=60)


def test_phrases_of_no_rows_and_colliding_keys(spark, monkeypatch):
    assert phrases.collocations(_docs(spark, [])).collect() == []
    rows = _phrase_rows(40)
    true_read = phrases._read

    def weak(data, offs, lang, salt):
        *rest, key, joined = true_read(data, offs, lang, salt)
        return *rest, (key % np.uint64(5) + np.uint64(1) if salt == 0 else key), joined

    salts, counted = [], phrases.word_counts
    monkeypatch.setattr(phrases, "word_counts", lambda t, salt: (salts.append(salt), counted(t, salt))[1])
    monkeypatch.setattr(phrases, "_read", weak)
    words, nodes = phrases.phrase_counts(_docs(spark, rows), Workspace(spark, "t"), least=5)
    assert salts == [0, 1] and words.groupBy("key").count().where("count > 1").count() == 0 and nodes.count() > 20


def test_scores_are_exact_beyond_64_bits(spark):
    big = 14_000_000_000_000
    df = spark.createDataFrame([(big - 1, big, big - 1), (3, 7, 9)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases._score("a", "l", "r")).collect()]
    assert got == [10**6 * (big - 1) ** 2 // (big * (big - 1)), 10**6 * 9 // 63]
