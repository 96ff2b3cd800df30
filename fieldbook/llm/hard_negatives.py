"""Hard negatives by a vertical scan: each anchor reads the dimensions of a block of vectors in descending magnitude of its
own components, and drops rows as soon as what is left to read can't bring them into a wanted window.

Vectors lie in tasks as columns. After each few dimensions a row's score is known up to the least and most that the block's
minima and maxima allow for the rest. That interval is held against

* the best positives so far, when the positives are looked for (all rows of the anchor's label), or
* the windows of the anchor's positives and what fills them so far, when the negatives are,

and the bitmap of candidates shrinks; rows that survive all dimensions have exact scores. Every vector is scanned by its own
task for a bounded chunk of anchors at a time; a task returns its few best rows of each anchor and window, and these are
merged. No rows meet by a label or a vector, so that none is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import Workspace

POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
STEP = 8  # dimensions read between two looks at the bounds
ANCHOR_BYTES = 16 << 20  # of one chunk's vectors, which is sent to all tasks
LARGEST = 1 << 24  # scaled components beyond this count as this, so that no score leaves 64 bits

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
SCORED = "anchor_id long, wanted long, id long, score long"
_TYPES = [pa.int64()] * 4


def scaled(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v, asks): the rows that take part, with components floor(256 x)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(LARGEST)
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(most)), F.lit(-most))).cast("int"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"),
                       F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).select("s").collect()
    return rows.where(F.size("v") == (size[0][0] if size else 0))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, best first."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Block:
    """Vectors as columns with each column's least and most."""

    def __init__(self, v: np.ndarray):
        self.columns = np.ascontiguousarray(v.T)
        self.low, self.high = (f(self.columns, axis=1) if len(v) else np.zeros(v.shape[1], dtype=np.int64) for f in (np.min, np.max))

    def scan(self, anchor: np.ndarray, rows: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of those of ``rows`` that ``alive(least, most)`` lets through at every look."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack([a * self.low[order], a * self.high[order]])
        rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
        least, most = rest(ends.min(0)), rest(ends.max(0))
        score = np.zeros(len(rows), dtype=np.int64)
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            for d, x in zip(dims.tolist(), a[at:at + STEP]):
                score += x * self.columns[d][rows]
            left = min(at + STEP, len(order))
            keep = alive(score + least[left], score + most[left])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


class Best:
    """The best rows met so far of one window, and the score that a further one must reach."""

    __slots__ = ("ids", "score", "k")

    def __init__(self, k: int):
        self.ids, self.score, self.k = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), k

    @property
    def floor(self):
        return self.score[-1] if len(self.score) == self.k else np.iinfo(np.int64).min

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        at = _best(ids, score, self.k)
        self.ids, self.score = ids[at], score[at]

    def promised(self, least: np.ndarray) -> int:
        """A score that k rows are sure to reach, by what was met and by the lower bounds ``least``."""
        if len(least) >= self.k:
            return max(self.floor, np.partition(least, len(least) - self.k)[len(least) - self.k])
        return self.floor


def _rows(found) -> pa.RecordBatch:
    cols = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (list(zip(*found)) or [[]] * 4)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=["anchor_id", "wanted", "id", "score"])


def _scan_positives(vectors: DataFrame, anchors, k: int) -> DataFrame:
    """(anchor_id, wanted 0, id, score): each task's best ``k`` of every anchor's label."""

    def run(batches):
        ids, labels, v = anchors.value
        best = [Best(k) for _ in ids]
        for b in batches:
            own, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            block = Block(_matrix(b.column(2)))
            of = {x: np.flatnonzero(label == x) for x in np.unique(label).tolist()}
            for i, held in enumerate(best):
                rows = of.get(int(labels[i]))
                if rows is None:
                    continue
                rows = rows[own[rows] != ids[i]]
                rows, score = block.scan(v[i], rows, lambda least, most: most >= held.promised(least))
                held.add(own[rows], score)
        yield _rows([(np.full(len(h.ids), i), np.zeros(len(h.ids), dtype=np.int64), h.ids, h.score) for i, h in zip(ids, best)])

    return vectors.mapInArrow(run, SCORED)


def _scan_negatives(vectors: DataFrame, anchors, k: int, low_percent: int) -> DataFrame:
    """(anchor_id, wanted, id, score): each task's best ``k`` other-label rows in the window under every wanted score."""

    def run(batches):
        ids, labels, v, wanted = anchors.value
        floors = [[-(-low_percent * x // 100) for x in w] for w in wanted]
        best = [[Best(k) for _ in w] for w in wanted]
        for b in batches:
            own, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            block = Block(_matrix(b.column(2)))
            other = {x: np.flatnonzero(label != x) for x in np.unique(labels).tolist()}
            for i, held in enumerate(best):
                windows = [(lo, hi, h) for lo, hi, h in zip(floors[i], wanted[i], held) if lo <= hi]
                if not windows:
                    continue

                def alive(least, most):
                    out = np.zeros(len(least), dtype=bool)
                    for lo, hi, h in windows:
                        sure = least[(least >= lo) & (most <= hi)]
                        out |= (most >= max(lo, h.promised(sure))) & (least <= hi)
                    return out

                rows, score = block.scan(v[i], other[int(labels[i])], alive)
                for lo, hi, h in windows:
                    inside = (score >= lo) & (score <= hi)
                    h.add(own[rows[inside]], score[inside])
        yield _rows([(np.full(len(h.ids), i), np.full(len(h.ids), w), h.ids, h.score)
                     for i, ws, hs in zip(ids, wanted, best) for w, h in zip(ws, hs)])

    return vectors.mapInArrow(run, SCORED)


def _merged(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor_id", "wanted").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``is_anchor`` holds of and
    each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels that score between
    ``low_percent`` of the positive's score and that score.

    Components count as floor(256 x), scores are integer inner products; ties go to the smaller id. Rows without id, label or
    vector, with null or non-finite components, or of another length than most have (the shortest of equals) take no part.
    Zero vectors do. A repeated id is a candidate in each of its rows, but never its own anchor's, and asks once (the smallest
    row). Empty tables, anchors without a positive and positives without a negative give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "hard-negatives")
    rows = ws.keep(scaled(vectors, is_anchor, id_col, vector_col, label_col))
    asking = ws.keep(rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    sizes = asking.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    chunks = max(1, -(-sizes[0] * 8 * max(sizes[1] or 1, 8) // anchor_bytes))
    out = spark.createDataFrame([], FOUND)
    for c in range(chunks):
        part = asking.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).collect()
        if not part:
            continue
        ids, labels = (np.array([r[x] for r in part], dtype=np.int64) for x in ("id", "label"))
        v = np.array([r["v"] for r in part], dtype=np.int64).reshape(len(part), -1)
        sent = spark.sparkContext.broadcast((ids, labels, v))
        pos = ws.keep(_merged(_scan_positives(rows, sent, positives), positives).select("anchor_id", F.col("id").alias("positive_id"), "score"))
        scores = {r["anchor_id"]: r["w"] for r in pos.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score")).alias("w")).collect()}
        windows = spark.sparkContext.broadcast((ids, labels, v, [[int(x) for x in scores.get(int(i), [])] for i in ids]))
        neg = ws.keep(_merged(_scan_negatives(rows, windows, negatives, low_percent), negatives))
        got = pos.join(neg.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score"),
                       (pos["anchor_id"] == neg["anchor_id"]) & (pos["score"] == neg["wanted"])).select(
            pos["anchor_id"], "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
            pos["score"].alias("positive_score"), "negative_score")
        out = out.unionByName(got)
    return out
