"""N-gram Jaccard join: a size-aware heavy-light set join over distinct word shingles.

Every document becomes its set of distinct five-word shingles. Two documents link when their sets overlap by at least
``percent`` of their union. The steps, each over all documents:

1. Equal sets are one class; from here on a class stands for its documents.
2. A shingle held by one class alone can be in no overlap, so the shingles held by two or more are found (``exchange``)
   and a class of which fewer than ``percent`` of the shingles are shared leaves: it can link with nothing.
3. With any fixed order of shingles, two linked sets have a common element among the first ``n - ceil(percent n) + 1``
   of each, and two among one more. Unshared shingles come first in the order, then hash order. Small sets enumerate
   the 2-subsets of that prefix, large ones enter the inverted lists of its single elements, sets near the boundary do
   both, so that a pair of a small and a large set meets in a list. The boundary is the one of least cost, counted
   over all classes: subsets made on one side, list partners met on the other.
4. Stars first: by a few of each set's keys, lists name a centre, the best covered member and then, round by round, one
   by hash. Members of another component are verified against it, exactly, and links join components. A group of
   thousands of near copies is so made one with a few pairs for each member. The rounds end when one leaves nearly as many
   pairs to be met in lists as it found. What still stands in different components but shares a list is then paired
   within it (a long list in blocks, by its pairs), kept if parity sketches and the number of common prefix elements allow
   the overlap, and verified. No pair of different components that could link goes unverified; pairs within one need none.

A parity sketch has a bit for each of 1,024 parts of the hash space: whether a set's number of shared shingles in it is
odd. Where two sketches differ, so do the sets, so a count of the differing bits bounds their difference from below.

Verification intersects the shared shingles only, which is exact since the others are in no intersection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm import bytescan, exchange
from fieldbook.llm.common import Workspace
from fieldbook.operators.graph import connected_components
from fieldbook.plans.skew import salted_join

U = np.uint64
PERCENT = 75
WORDS = 5
STAR_KEYS = 6
SKETCH = 16  # longs of a parity sketch
MEETING = 0.01  # cost of two members met in a list, against one row made
STAR_SHARE = 16  # one key in so many besides
STAR_ROUNDS = 6
STAR_GAIN = 0.1  # of the pairs left in lists, which a round has to take away for another to follow


def _sets(texts: pa.Array, words: int):
    """For each chunk of texts: rows in it, their set sizes, two set fingerprints, and the sorted (row, shingle)."""
    for lo, hi, data, offs in bytescan.chunks(texts):
        row, h = bytescan.shingles(data, offs, words)
        n = np.bincount(row, minlength=hi - lo)
        sums = [np.zeros(len(h) + 1, dtype=U) for _ in range(2)]
        np.cumsum(bytescan.mix(h ^ U(0x1F83D9ABFB41BD6B)), out=sums[0][1:])
        np.cumsum(bytescan.mix(h ^ U(0x5BE0CD19137E2179)), out=sums[1][1:])
        end = np.cumsum(n)
        prints = [bytescan.mix((s[end] - s[end - n]) ^ n.astype(U)) for s in sums]
        yield lo, hi, n, prints, row, h


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n, set1, set2): size and 128-bit fingerprint of each document's set."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, n, prints, _, _ in _sets(b.column(1), words):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), *[pa.array(p.view(np.int64)) for p in prints]],
                    names=["id", "n", "set1", "set2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n long, set1 long, set2 long")


def _post_shingles(docs: DataFrame, text_col: str, words: int, parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for _, _, n, prints, row, h in _sets(b.column(0), words):
                _, first = np.unique(prints[0], return_index=True)  # copies within the chunk are posted once
                keep = np.zeros(len(n), dtype=bool)
                keep[first] = True
                keep = keep[row]
                if keep.any():
                    yield exchange.post(prints[0][row[keep]], h[keep], None, parts)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, exchange.POSTED)


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """Classes that may link, with their shared shingles sorted and the first of them that can decide."""

    def run(batches):
        for b in batches:
            out = []
            for i, n, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = np.unique(np.frombuffer(items.as_py(), dtype="<u8"))
                slots = len(t) - _need(n, percent) + 1
                if slots >= 1:
                    part = np.bincount((bytescan.mix(t) % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                    sketch = np.packbits(part.astype(np.uint8)).view(np.int64)
                    out.append((i, n, len(t), slots, t.tobytes(), t[:slots + 1].view(np.int64).tolist(), sketch.tolist()))
            if out:
                kinds = (*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)],
                                                 names=["id", "n", "shared", "slots", "tokens", "first", "sketch"])

    return rows.select("id", "n", "items").mapInArrow(
        run, "id long, n long, shared long, slots long, tokens binary, first array<long>, sketch array<long>")


def choose_boundary(classes: DataFrame) -> int:
    """Size up to which a set enumerates 2-subsets: the boundary of least total cost over all classes.

    A set with ``m`` deciding elements makes m (m + 1) / 2 subsets of the prefix that is longer by one. In lists it costs
    one row and the list's other members for each element. The candidates are powers of the square root of two.
    """
    lists = classes.select(F.explode(F.slice("first", F.lit(1), F.col("slots").cast("int"))).alias("t")).groupBy("t").count()
    met = lists.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 1.0
    sizes = sorted({0, *[int(2 ** (i / 2)) for i in range(2, 49)]})
    m = F.col("slots").cast("double")
    subsets, single = m * (m + 1) / 2, m * (1 + F.lit(MEETING * float(met)))
    costs = classes.agg(*[F.sum(F.when(F.col("n") <= x, subsets).otherwise(0.0)
                                + F.when(F.col("n") * 4 >= 3 * (x + 1), single).otherwise(0.0)).alias(f"c{x}") for x in sizes])
    row = costs.first()
    return min(sizes, key=lambda x: (row[f"c{x}"] or 0.0, x))


def signatures(classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(pos, key, kind, id, n, cover): kind 0 for inverted lists, 1 for 2-subsets."""
    about = [F.lit(0).alias("kind"), "id", "n", (F.col("shared") / F.col("n")).alias("cover")]
    lists = classes.where(F.col("n") * 100 >= percent * (boundary + 1)).select(
        F.posexplode(F.slice("first", F.lit(1), F.col("slots").cast("int"))).alias("pos", "key"), *about)
    pairs = F.flatten(F.transform("first", lambda x, i: F.transform(
        F.slice("first", i + 2, F.greatest(F.size("first") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    about[0] = F.lit(1).alias("kind")
    subsets = classes.where(F.col("n") <= boundary).select(F.posexplode(pairs).alias("pos", "key"), *about)
    return lists.unionByName(subsets)


def _alike(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _near(percent: int):
    """Whether two sketched sets (the second's columns end in 2) can overlap enough: their difference is at least what
    either holds alone and the differing bits."""
    alone = F.col("n") - F.col("shared") + F.col("n2") - F.col("shared2")
    for i in range(SKETCH):
        alone = alone + F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i))))
    return alone * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) whose overlap is at least ``percent`` of their union. The fuller side travels once a pair."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    look = lambda c, x: classes.select(F.col("id").alias(c), *[F.col(v).alias(v + x) for v in ("n", "shared", "sketch")])
    pairs = pairs.select("a", "b").join(look("a", ""), "a").join(look("b", "2"), "b").where(_near(percent))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches):
        for x in batches:
            na, nb = x.column(2).to_numpy(), x.column(3).to_numpy()
            met = np.fromiter((len(np.intersect1d(np.frombuffer(s.as_py(), "<u8"), np.frombuffer(t.as_py(), "<u8"), True))
                               for s, t in zip(x.column(4), x.column(5))), dtype=np.int64, count=len(na))
            ok = pa.array(100 * met >= percent * (na + nb - met))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _joined(ws: Workspace, comps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after ``links`` between ids: the components they touch are joined, the others stay."""
    name = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    edges = ws.keep(links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    new = connected_components(nodes, edges, "id", "new").withColumnRenamed("id", "component")
    return ws.keep(comps.join(new, "component", "left").select("id", F.coalesce("new", "component").alias("component")))


def _star(members: DataFrame, comps: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): the centre of a list and the members that are of other components, by the first keys of each set and a few
    others, new ones each turn."""
    some = (F.col("pos") < STAR_KEYS) | (F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(STAR_SHARE)) == 0)
    at = members.where(some).join(comps, "id")
    rank = F.col("cover") if turn == 0 else F.xxhash64("id", F.lit(turn)).cast("double")
    centre = F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("minus"), "n", "component")).alias("c")
    lists = (at.groupBy("key", "kind").agg(centre, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
             .select("key", "kind", (-F.col("c.minus")).alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca")))
    other = (F.col("component") != F.col("ca")) & _alike("n", "na", percent)
    return at.join(lists, ["key", "kind"]).where(other).select("a", F.col("id").alias("b")).distinct()


def _pairs_left(members: DataFrame, comps: DataFrame) -> float:
    """Pairs of members of different components that meet in lists, a pair counted in each of its lists; 0 only if none do."""
    own = members.join(comps, "id").groupBy("key", "kind", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
    lists = own.groupBy("key", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("parts"))
    pairs, parts = lists.agg(F.sum(F.col("n") * F.col("n") - F.col("same")), F.max("parts")).first()
    return max(pairs / 2, 1.0) if (parts or 0) > 1 else 0.0


def _met(ws: Workspace, members: DataFrame, comps: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different components that meet in enough lists, and whose sketches allow the overlap."""
    at = members.join(comps, "id")
    open_keys = (at.groupBy("key", "kind").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                 .where("lo < hi").select("key", "kind"))
    look = classes.select("id", "shared", "sketch")
    at = ws.keep(at.join(open_keys, ["key", "kind"]).select("key", "kind", "id", "n", "component").join(look, "id"))
    other = at.select("key", "kind", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "shared", "sketch")])
    need = lambda c: F.ceil(F.col(c) * percent / 100)
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    pairs = (salted_join(at, other, ["key", "kind"], ["id"])
             .where((F.col("component") < F.col("component2")) & _alike("n", "n2", percent) & _near(percent))
             .groupBy(F.col("id").alias("a"), F.col("id2").alias("b"))
             .agg(count(0).alias("c0"), count(1).alias("c1"), F.max("n").alias("n"), F.max("n2").alias("n2")))
    enough = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent)) - F.greatest(need("n"), need("n2")) + 1)
    return pairs.where((F.col("c0") >= enough) | (F.col("c1") >= enough * (enough + 1) / 2)).select("a", "b")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    A text of fewer than ``words`` words is one shingle; null and blank texts have none, link with nothing and are
    their own component. Rows that repeat an id are each returned; a null id is never a component's name and gets the
    component of its text's class, or null. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    sets = ws.keep(shingle_sets(docs, id_col, text_col, words))
    reps = ws.keep(sets.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("set1", "set2", "n")
                   .agg(F.min("id").alias("rep")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = exchange.buckets(total)
    shared = exchange.answers(_post_shingles(docs, text_col, words, parts), parts)
    gathered = shared.withColumnRenamed("owner", "set1")
    one = reps.groupBy("set1").agg(F.min(F.struct("rep", "n")).alias("r")).select("set1", "r.*")
    classes = ws.keep(_survivors(gathered.join(one, "set1").select(F.col("rep").alias("id"), "n", "items"), percent))
    boundary = choose_boundary(classes)
    members = ws.keep(signatures(classes, boundary, percent))

    comps = ws.keep(classes.select("id", F.col("id").alias("component")))
    left = _pairs_left(members, comps)
    for turn in range(STAR_ROUNDS if left else 0):
        links = ws.keep(verified(_star(members, comps, turn, percent), classes, percent))
        if not links.limit(1).count():
            break
        comps = _joined(ws, comps, links)
        before, left = left, _pairs_left(members, comps)
        if left > (1 - STAR_GAIN) * before or not left:
            break

    if left:
        more = ws.keep(verified(_met(ws, members, comps, classes, percent), classes, percent))
        if more.limit(1).count():
            comps = _joined(ws, comps, more)

    named = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set1", "set2", "n", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(named, ["set1", "set2", "n"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
