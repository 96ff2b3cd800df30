"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; its leaves are small enough for the whole table's vectors to be spread over, up
to ``MAX_LEAVES``. Every vector goes down to one leaf. A query keeps a priority queue of nodes by the distance to their
centre and opens the nearest, so leaves come out in the order of promise; it visits as many as calibration found to be
needed: sample queries are compared with all vectors, and the visits are widened until their recall is reached. A query
whose leaves hold too few vectors goes on past them, by the leaves' counts.

Queries and vectors of a leaf meet in blocks of both, so that no task holds a leaf, however hot; each block returns its
best candidates of each query, and the blocks' lists are merged. Distances are exact, in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import Workspace, small

SAMPLE = 20_000  # vectors that the tree is fitted on, at most
BRANCH = 8
LEAF_ROWS = 2000
MAX_LEAVES = 4096
CALIBRATION = 64  # queries compared with all vectors
RECALL = 0.95
BLOCK = 4096


@dataclass
class Tree:
    """``centres[i]`` and ``children[i]`` of node i; ``leaf[i]`` is a leaf's number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node on the way down, the first of equals."""
        out = np.empty(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(k, rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int, held: list[int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, and further ones until they hold ``least`` vectors by the
        counts ``held``."""
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < most or (held is not None and rows < least)):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(int(self.leaf[node]))
                rows += held[out[-1]] if held is not None else 0
                continue
            for d, k in zip(((self.centres[kids] - q) ** 2).sum(1), kids):
                heapq.heappush(queue, (float(d), k))
        return out


def _kmeans(x: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
    return c


def build(sample: np.ndarray, rows: int, seed: int = 5) -> Tree:
    """A tree for a table of ``rows`` vectors. A node whose sample is all one point stays a leaf."""
    rnd = np.random.default_rng(seed)
    leaves = min(max(rows // LEAF_ROWS, 1), MAX_LEAVES)
    most = max(len(sample) / leaves, 2.0)
    centres, children, leaf = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1]
    todo, done = [(0, np.arange(len(sample)))], 0
    while todo:
        node, at = todo.pop(0)
        k = min(BRANCH, len(at))
        if len(at) > most and (sample[at] != sample[at[0]]).any():
            c = np.unique(_kmeans(sample[at], k, rnd), axis=0)
            near = np.argmin((c * c).sum(1) - 2 * sample[at] @ c.T, axis=1)
            parts = [(c[i], at[near == i]) for i in range(len(c)) if (near == i).any()]
            if len(parts) > 1:
                for centre, rest in parts:
                    centres.append(centre)
                    children.append([])
                    leaf.append(-1)
                    children[node].append(len(centres) - 1)
                    todo.append((len(centres) - 1, rest))
                continue
        leaf[node] = done
        done += 1
    return Tree(np.stack(centres), children, np.array(leaf))


def _closest(keys: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of ``x`` for each query, ties to the smaller id; a query's own id is left out."""
    out = []
    for qid, v in zip(keys, q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        d = np.where(ids == qid, np.inf, d)
        if len(d) > k:
            edge = np.partition(d, k - 1)[k - 1]
            at = np.flatnonzero(d <= edge)
        else:
            at = np.arange(len(d))
        at = at[np.lexsort((ids[at], d[at]))][:k]
        at = at[np.isfinite(d[at])]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at], "score": d[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles. Null or zero vectors, ones that hold nulls or non-finite numbers, and
    ones of another length than most have are left out; so are rows without an id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).select("s").collect()
    return rows.where(F.size("v") == (size[0][0] if size else 0))


def _met(spread: DataFrame, asked: DataFrame, k: int, ws: Workspace) -> DataFrame:
    """(query_id, vec_id, score): the nearest ``k`` of each query among the vectors of the leaves it visits.

    ``spread``: (id, v, leaf); ``asked``: (id, v, leaf), one row a visit. Both sides of a leaf are cut into blocks by
    hash, by their counts, and every block of the one meets every block of the other.
    """
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = ws.keep(blocks(spread, "vb").join(blocks(asked, "qb"), "leaf"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    fill = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = spread.join(F.broadcast(sizes), "leaf").withColumn("b", part("vb")).withColumn("c", fill("qb")).select("leaf", "b", "c", "id", "v")
    q = asked.join(F.broadcast(sizes), "leaf").withColumn("c", part("qb")).withColumn("b", fill("vb")).select("leaf", "b", "c", "id", "v")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _closest(right["id"].to_numpy(), np.stack(left["v"]), left["id"].to_numpy(), np.stack(right["v"]), k)

    found = a.groupBy("leaf", "b", "c").cogroup(q.groupBy("leaf", "b", "c")).applyInPandas(
        nearest, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = RECALL, visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds of, its ``k`` nearest among all other rows.

    Ids that repeat are candidates each, but a query leaves out all rows of its own id. Queries with fewer than ``k``
    candidates get all there are; others get ``k``. Empty tables and tables without queries give no rows. ``visits`` overrides the
    calibrated number of leaves, which is exceeded where these hold fewer than ``k`` candidates.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "kmeans-tree")
    rows = ws.keep(usable(vectors.withColumn("__q", is_query).withColumnRenamed(id_col, "__id"), "__id", vector_col))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), -1)
    tree = build(x, total)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(np.stack(v)) if len(v) else [], dtype="int32")

    spread = ws.keep(rows.withColumn("leaf", leaf_of("v")))
    named = rows.withColumnRenamed("id", id_col)
    queries = named.where(is_query).dropDuplicates([id_col]).withColumnRenamed(id_col, "id")
    held = [0] * tree.leaves
    for r in spread.groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]
    own = spread.select("id").join(small(ws.keep(queries.select("id"))), "id").groupBy("id").agg(F.count(F.lit(1)).alias("own"))

    def asked(q: DataFrame, most: int) -> DataFrame:
        @F.pandas_udf("array<int>")
        def leaves(v: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([tree.visits(y, most, held, k + int(n)) for y, n in zip(v, own)])

        return ws.keep(q.join(own, "id").withColumn("leaf", F.explode(leaves("v", "own"))).select("id", "v", "leaf"))

    if visits is None:
        visits = calibrate(ws, spread, tree, queries, k, recall)
    return _met(spread, asked(queries, visits), k, ws).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrate(ws: Workspace, spread: DataFrame, tree: Tree, queries: DataFrame, k: int, recall: float) -> int:
    """The number of visits, widened by a quarter at a time, at which sample queries find ``recall`` of their true
    neighbours. The truth comes from all vectors: each task compares its share with the few sample queries."""
    q = queries.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION).collect()
    ids, v = np.array([r["id"] for r in q], dtype=np.int64), np.array([r["v"] for r in q], dtype=np.float64)

    def scan(batches):
        for b in batches:
            got = _closest(ids, np.stack(b["v"]), b["id"].to_numpy(), v, k)
            leaf = b.drop_duplicates("id").set_index("id")["leaf"]
            yield got.assign(leaf=leaf.loc[got["vec_id"]].to_numpy())

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    true = (spread.mapInPandas(scan, "query_id long, vec_id long, score double, leaf int")
            .withColumn("rank", place).where(F.col("rank") <= k).collect())
    order = {int(i): tree.visits(y, tree.leaves) for i, y in zip(ids, v)}
    need = sorted(order[r["query_id"]].index(r["leaf"]) + 1 for r in true)
    if not need:
        return 1
    wanted = need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]
    most = 1
    while most < wanted:
        most = max(most + 1, most * 5 // 4)
    return min(most, tree.leaves)
