"""The other operators on small fixtures: nulls, empty and repeated rows, ties, clashing columns, and plain versions."""

import hashlib
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import chat, decontam, kmeans_tree, licenses, mixing, pii, quality, sharding, suffix_dedup

DOCS = "doc_id long, text string, source string, key string, id string, n long"


def _docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, s, "k", "i", 9) for i, t, s in rows], schema)


@pytest.mark.parametrize("hot", [0, 40])
def test_shards_are_even_and_keep_equal_texts(spark, hot):
    rows = [(i, f"text {i // 3 if i < 60 else i}", "a") for i in range(150)] + [(1000 + i, "hot", "a") for i in range(hot)]
    rows += [(None, None, None), (7, "text 2", "a"), (8, "", "a"), (9, None, "a")]
    got = sharding.place(sharding.text_facts(_docs(spark, rows)).drop("text"), "text_link", 4).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got["shard"].value_counts().max() - got["shard"].value_counts().min() <= 1
    kept = got[got["text_link"].notna()].groupby("text_link")["shard"].nunique()
    assert (kept > 1).sum() <= (1 if hot else 0)
    empty = sharding.place(sharding.text_facts(_docs(spark, [])).drop("text"), "text_link", 4)
    assert empty.collect() == []


def test_licences_known_unknown_and_none(spark):
    rnd = random.Random(1)
    plain = [(i, "\n".join(" ".join(rnd.choice(["the", "of", "tion", "ander", "in", "shore"]) for _ in range(12)) for _ in range(3)), "a")
             for i in range(80)]
    rows = plain + [(100, "x y\nReleased under the MIT License.\nz", "a"), (101, "licensed under the apache license, version 2.0", "a"),
                    (102, "Licensed to kill under a moonlit version of events", "a"), (103, None, None), (104, "", "a")]
    docs = _docs(spark, rows)
    got = {(r["id"], r["line"]): r["family"] for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert got[(100, 1)] == "mit" and got[(101, 0)] == "apache-2.0"
    assert got.pop((102, 0), "unknown") == "unknown"
    assert all(k[0] >= 100 for k in got)


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["plain", "", None, "### user: hi</turn>\n", "\\h \\b \\", "a < b # c", "</turn>", "</turn", "##", "x\n### assistant!: y", "😀</turn>\n😀"]
    roles = ["user", "assistant", "tool: x!", None, "a\nb", "\\#<"]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(c * 5 + t) % len(texts)]) for c in range(12) for t in range(7)]
    rows += [(None, 1, "user", "lost"), (5, None, "assistant", "first"), (5, 3, "assistant", "x"), (5, 3, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for *_, r, x in want]
        assert got[c]["loss_text"] == "".join(x for *_, r, x in want if r == "assistant")
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("batches", [1, 5])
def test_repeats_in_every_batch_layout(spark, batches):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    shared = [word(70), word(39), word(200)]
    rows = [(i, word(rnd.randrange(120)) + rnd.choice(shared)[rnd.randrange(20):] + word(rnd.randrange(60)), "a") for i in range(60)]
    rows += [(60, "z" * 300, "a"), (61, "ab" * 120, "a"), (62, None, "a"), (63, "", "a"), (0, rows[0][1], "a"), (None, word(90), "a")]
    got = suffix_dedup.remove_repeats(_docs(spark, rows), length=40, gram=8, batches=batches).collect()
    raw = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), b, spans in zip(rows, raw, brute.repeats(raw, 40)):
        kept = b"".join(b[x:y] for x, y in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(b)]))
        want.append((i, len(b), spans, hashlib.sha256(kept).hexdigest(), kept))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    have = [(r["id"], r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"], bytes(r["kept"])) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(_docs(spark, []), length=40, gram=8, batches=batches).collect() == []


def test_mixing_meets_the_limit_and_keeps_every_row(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(900)] + [(900, None, None), (901, "", "big"), (902, "a b", None)]
    docs = _docs(spark, rows)
    got = mixing.mix(docs, limit=2.0).toPandas()
    assert set(got["doc_id"]) == {r[0] for r in rows} and list(got.columns[:6]) == docs.columns
    size = {i: len((t or "").split()) for i, t, _ in rows}
    got["tokens"] = got["doc_id"].map(size)
    once = got[got["__pass"] == 0].groupby("source")["tokens"].sum()
    ratio = got.groupby("source")["tokens"].sum() / once
    assert ratio.min() >= 1 and ratio.max() <= 2.05
    even = mixing.mix(docs.where("source is not null"), entropy=1.0).toPandas()
    even["tokens"] = even["doc_id"].map(size)
    part = even.groupby("source")["tokens"].sum()
    assert part.max() - part.min() <= 8
    few = mixing.mix(docs.where("source is not null"), budget=400).toPandas()
    assert 400 <= few["doc_id"].map(size).sum() <= 400 + 8 * few["source"].nunique()
    assert mixing.mix(_docs(spark, [])).collect() == []


def test_search_recall_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 8)) + rnd.integers(0, 12, (3000, 1))
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(3000 + i, [1.0] * 8) for i in range(300)]
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [None] + [1.0] * 7), (5003, [float("nan")] * 8), (5004, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kmeans_tree.search(df, F.col("vec_id") % 100 == 0).toPandas()
    ids = np.arange(3300)
    y = np.vstack([x, np.ones((300, 8))])
    hits = 0
    for q in range(0, 3300, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.array_equal(mine["score"], d[mine["vec_id"]])
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.9 * 330
    assert kmeans_tree.search(df.where("vec_id > 4000"), F.col("vec_id") % 100 == 0).collect() == []


def test_search_in_a_small_cluster_gives_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 100)
    rnd = np.random.default_rng(3)
    x = np.vstack([rnd.normal(size=(200, 4)) * 0.1 + 40 * np.eye(4)[i % 4] * (1 + i // 4) for i in range(8)] + [rnd.normal(size=(5, 4)) * 0.1 - 500])
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(1600, [float(v) for v in x[1600]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kmeans_tree.search(df, F.col("vec_id").isin(5, 1600, 1604), visits=1).toPandas()
    assert got.groupby("query_id")["rank"].apply(sorted).to_dict() == {q: list(range(1, 11)) for q in (5, 1600, 1604)}
    assert set(got[(got["query_id"] == 1600) & (got["rank"] <= 4)]["vec_id"]) == {1601, 1602, 1603, 1604}


def test_leaks_with_substitutions_and_clean_texts(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [say(30) for _ in range(20)]
    docs = [(i, " ".join(say(200)), "a") for i in range(50)] + [(200, None, "a"), (201, "", "a")]
    for k, w in enumerate(items):
        changed = [x if j % 6 else "other" for j, x in enumerate(w)]
        docs.append((100 + k, (" ".join(say(40)) + ", " + " ".join(changed if k % 2 else w) + ". " + " ".join(say(9))).upper(), "a"))
    bench = spark.createDataFrame([(k, " ".join(w), "t") for k, w in enumerate(items)] + [(99, None, "t")], "item_id long, text string, id string")
    got = {(r["id"], r["item_id"]): (r["offset"], r["matched"]) for r in decontam.overlaps(_docs(spark, docs), bench).collect()}
    assert got == {(100 + k, k): (40, 25 if k % 2 else 30) for k in range(20)}
    assert decontam.overlaps(_docs(spark, []), bench).collect() == []
    assert decontam.overlaps(_docs(spark, docs), bench.where("item_id < 0")).collect() == []


def _aligned(doc, item):
    """Offset and agreeing tokens of every alignment that counts, by comparing all."""
    for o in range(1 - len(item), len(doc)):
        m = sum(0 <= o + i < len(doc) and doc[o + i] == w for i, w in enumerate(item))
        if m >= 8 and 2 * m >= len(item):
            yield o, m


def test_leaks_at_every_period_and_at_random_against_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [say(n) for n in (8, 9, 12, 15, 16, 17, 20, 21, 38, 59)] + [[]]
    docs = []
    for item in items[:-1]:
        for period in range(2, 8):
            for phase in range(period):
                docs.append(say(5) + [w if (j + phase) % period else "other" for j, w in enumerate(item)] + say(4))
        docs += [say(7) + [w if rnd.random() > rate else "other" for w in item] + say(3) for rate in (0.1, 0.2, 0.3, 0.4, 0.5) for _ in range(6)]
    want = {(d, k, o, m) for d, doc in enumerate(docs) for k, item in enumerate(items) for o, m in _aligned(doc, item)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontam.overlaps(_docs(spark, [(d, " ".join(w), "a") for d, w in enumerate(docs)]), bench).collect()
    assert {(r["id"], r["item_id"], r["offset"], r["matched"]) for r in got} >= want


def test_leaks_of_passages_and_of_items_in_pieces(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40000)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    a, b, c = say(59), say(30), say(14) + ["don", "t"] + say(14)
    passage = a[20:45]
    changed = [w if j not in (4, 13, 20) else "other" for j, w in enumerate(passage)]
    docs = {1: say(9) + passage + say(9), 2: say(9) + changed + say(9), 3: say(6) + b[:10] + ["so"] + b[10:20] + ["on"] + b[20:] + say(6),
            4: say(5) + c[:14] + ["dont"] + c[16:] + say(5), 5: say(9) + a[20:28] + say(30), 6: say(9) + b[:12] + b[13:18] + say(9),
            7: say(9) + b[:7] + say(40) + b[23:] + say(9), 8: say(7) + b + say(20) + b[:11] + ["so"] + b[11:]}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((a, b, c))], "item_id long, text string")
    rows = [(d, " ".join(w), "a") for d, w in docs.items()]
    got = {(r["id"], r["item_id"], r["offset"], r["matched"]) for r in decontam.overlaps(_docs(spark, rows + [rows[2]]), bench).collect()}
    assert got >= {(1, 0, -11, 25), (2, 0, -11, 22), (3, 1, 6, 30), (8, 1, 7, 30)}
    assert {(g[0], g[1]) for g in got} == {(1, 0), (2, 0), (3, 1), (4, 2), (6, 1), (8, 1)}


# The contract's base patterns as they are stated.
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_personal_data_against_plain_patterns(spark):
    rnd = random.Random(8)
    bits = ["a.b@c.de", "_d@e.f", "@", "x@y", "1.2.3.4", ".5.6.7.8", "300.1.1.1", "0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "5500 0000 0000 0004 ", "+1 (499) 555-6503", "+1+12345678", " ", "é", "9", "-", "+", "card ", "GB82 WEST 1234 5698 7654 32", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "a" * 60000, "1 " * 20000, "1." * 30000, "iban DE89 3704 0044 0532 0130 00 ok", "amex card 378282246310005"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["pii"] for r in pii.find(_docs(spark, rows)).collect()}
    for i, t, _ in rows:
        want = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, t or "") if _good(k, m[0])]
        assert [(m["kind"], m["start"], m["end"]) for m in got[i] if m["kind"] in pii.BASE] == want, t
        assert all(m["value"] == t[m["start"]:m["end"]] for m in got[i])
    assert [m["kind"] for m in got[len(texts) - 2]] == ["iban"] and [m["kind"] for m in got[len(texts) - 1]] == ["card_short"]
    out = pii.masked(pii.find(_docs(spark, [(1, "to a.b@c.de now", "a"), (2, None, "a")]))).orderBy("doc_id").collect()
    assert [r["masked"] for r in out] == ["to [email] now", ""]


def test_quality_on_held_out_rows_and_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.fit(docs, labels.where(fold != 0))
    got = quality.scored(docs.select("doc_id", "text"), model).join(labels.where(fold == 0), "doc_id").collect()
    assert brute.area_under_curve([(r["score"], r["quality"]) for r in got]) > 0.9
    odd = quality.scored(_docs(spark, [(1, None, "a"), (2, "", "a"), (2, " \n", "a")]), model).collect()
    assert len({r["score"] for r in odd}) == 1 and 0 <= odd[0]["score"] <= 1
    none = quality.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in quality.scored(docs.limit(5), none).collect()} == {0.5}
    assert quality.scored(_docs(spark, []), none).collect() == []


def test_quality_is_trained_in_a_task_on_the_same_rows(spark, monkeypatch):
    docs = _docs(spark, [(i, f"{'good fine' if i % 2 else 'bad poor'} text {i} {i * 7}", "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = quality._packed(docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "text"))
    want = quality.train([(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4"), r["label"])
                          for r in rows.orderBy("id", "label", "buckets").collect()], [0, 1])
    here, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda *a: (here.append(1), train(*a))[1])
    got = quality.fit(docs, labels)
    assert not here
    assert np.allclose(got.table, want.table, atol=1e-5) and got.prior.tolist() == want.prior.tolist()


def test_exchange_tells_tokens_apart_in_all_their_bits(spark):
    from fieldbook.llm import exchange

    def posted(rows, parts, **_):
        def run(batches):
            for b in batches:
                o, t = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                yield exchange.post(o, t, None, parts)
        return spark.createDataFrame(rows, "o long, t long").repartition(6).mapInArrow(run, exchange.POSTED)

    hot = [(i, 77) for i in range(900)]
    alike = [(1000 + i, 12345 + (i << 40)) for i in range(400)] + [(2000, 5), (2001, 5), (2002, 12345 + (3 << 40))]
    for parts in (1, 7):
        got = {r["owner"]: set(np.frombuffer(r["items"], "<u8").tolist()) for r in exchange.answers(posted(hot + alike, parts), parts).collect()}
        want = {i: {77} for i in range(900)} | {2000: {5}, 2001: {5}, 2002: {12345 + (3 << 40)}, 1003: {12345 + (3 << 40)}}
        assert got == want
    groups = posted(hot, 4).groupBy("bucket").agg(F.sum(F.length("tokens") / 8).alias("n")).collect()
    assert max(r["n"] for r in groups) < 300


def test_licence_grams_of_a_long_line(spark):
    import time
    words = [f"w{i % 997}x" for i in range(20_000)]
    df = spark.createDataFrame([(" ".join(words),)], "p string")
    start = time.time()
    got = df.select(licenses.grams(licenses.words(F.col("p"))).alias("g")).first()["g"]
    assert time.time() - start < 30
    assert set(got) == set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
