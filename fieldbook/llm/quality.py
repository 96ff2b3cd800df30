"""Quality classifier: supervised subword embeddings.

A document's features are its words and its byte 4-grams, hashed into two halves of one table. Each bucket has a learned
vector; the document is their average, and a softmax layer over it gives the class. Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of the labelled rows, in one task. Whole texts are
used, in training and in scoring.

For scoring the layer is folded into the table: a softmax over averaged vectors is a softmax over averaged products of
vector and layer, so a text costs one look-up and one sum for each feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm import bytescan

U = np.uint64
BUCKETS = 1 << 17  # for words, and as many for n-grams
GRAM = 4
DIMENSIONS = 8
SAMPLE = 3000  # labelled rows that a model is fitted on, at most
EPOCHS = 12
RATE = 2.0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words and n-grams, in no order."""
    start, end, row = bytescan.word_bounds(data, offs)
    prints = bytescan.Prints(data)
    words = (prints(start, end) % U(BUCKETS)).astype(np.int64)
    at = np.arange(max(len(data) - GRAM + 1, 0))
    of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(at)]
    inside = at + GRAM <= offs[of + 1] if len(at) else np.zeros(0, dtype=bool)
    grams = (prints.windows(GRAM) % U(BUCKETS)).astype(np.int64) + BUCKETS
    return np.concatenate([row, of[inside]]), np.concatenate([words, grams[inside]])


@dataclass
class Model:
    """``table``: for each bucket and class the product of vector and layer; ``prior``: the classes' shares in training."""

    classes: list[int]
    table: np.ndarray
    prior: np.ndarray

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows by classes; the prior where a text has no feature."""
        n = len(offs) - 1
        row, bucket = features(data, offs)
        count = np.bincount(row, minlength=n)
        logits = np.stack([np.bincount(row, self.table[bucket, k], n) for k in range(len(self.classes))], axis=1)
        logits = logits / np.maximum(count, 1)[:, None]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        p[count == 0] = self.prior
        return p


def _packed(docs: DataFrame) -> DataFrame:
    """(id, label, buckets, shares): the distinct features of each text with their share of all."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in bytescan.chunks(b.column(2)):
                row, bucket = features(data, offs)
                key, count = np.unique(row * (2 * BUCKETS) + bucket, return_counts=True)
                row, bucket = key // (2 * BUCKETS), key % (2 * BUCKETS)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                out = []
                for i in range(hi - lo):
                    c = count[ends[i]:ends[i + 1]]
                    out.append((bucket[ends[i]:ends[i + 1]].astype("<i4").tobytes(),
                                (c / max(c.sum(), 1)).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     *[pa.array(x, pa.binary()) for x in zip(*out)]], names=["id", "label", "buckets", "shares"])

    return docs.select("id", "label", "text").mapInArrow(run, "id long, label int, buckets binary, shares binary")


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: list[int], epochs: int = EPOCHS, rate: float = RATE,
          seed: int = 7) -> Model:
    """Gradient descent, one document a step, with a rate that falls to nothing."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (2 * BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((len(classes), DIMENSIONS), dtype=np.float32)
    prior = np.bincount([y for *_, y in samples], minlength=len(classes)) / max(len(samples), 1)
    if not samples:
        prior = np.full(len(classes), 1 / len(classes))
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for k in rnd.permutation(len(samples)):
            bucket, share, y = samples[k]
            if not len(bucket):
                continue
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[bucket]
            z = layer @ mean
            e = np.exp(z - z.max())
            miss = e / e.sum()
            miss[y] -= 1
            back = miss @ layer
            layer -= lr * np.outer(miss, mean).astype(np.float32)
            vectors[bucket] -= (lr * share)[:, None] * back
    return Model(classes, (vectors @ layer.T).astype(np.float32), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, classes: tuple[int, ...] = (0, 1)) -> Model:
    """Fit on at most ``sample`` labelled ids, those of least hash, whatever the tables' order.

    Null labels, labels outside ``classes``, null ids and ids with contradicting labels are left out. With no labelled
    text the model gives every text the same score.
    """
    lab = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isin(*classes)).groupBy("id")
           .agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label"))
    chosen = lab.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _packed(texts.join(F.broadcast(chosen), "id")).orderBy("id", "label", "buckets").limit(sample)
    got = _learned(rows, list(classes)).toArrow()
    if not got.num_rows:
        return train([], list(classes))
    table, prior = (got.column(c)[0].as_buffer() for c in ("table", "prior"))
    return Model(list(classes), np.frombuffer(table, "<f4").reshape(-1, len(classes)), np.frombuffer(prior, "<f8"))


def _learned(rows: DataFrame, classes: list[int]) -> DataFrame:
    """(table, prior) of the model of the packed rows, which are trained on in one task: only the model reaches the driver.
    No row without any. ``rows`` must be a sorted and limited table, so that it is one partition in a fixed order."""

    def run(batches):
        samples = []
        for b in batches:
            samples += [(np.frombuffer(x.as_buffer(), "<i4"), np.frombuffer(s.as_buffer(), "<f4"), classes.index(y.as_py()))
                        for y, x, s in zip(b.column(0), b.column(1), b.column(2))]
        if samples:
            model = train(samples, classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (model.table.astype("<f4"), model.prior.astype("<f8"))],
                names=["table", "prior"])

    return rows.select("label", "buckets", "shares").mapInArrow(run, "table binary, prior binary")


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", positive: int = 1) -> DataFrame:
    """``docs`` with ``out``, the probability of class ``positive``. Null and blank texts get that class's share in training."""
    at = docs.columns.index(text_col)
    k = model.classes.index(positive)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for b in batches:
            text = b.column(at)
            text = text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string())
            p = [model.probabilities(data, offs)[:, k] for _, _, data, offs in bytescan.chunks(text)]
            score = pa.array(np.concatenate(p) if p else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)
