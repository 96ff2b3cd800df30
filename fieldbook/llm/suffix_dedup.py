"""Suffix-array dedup with a logarithmic family of indexes: remove every byte that lies in a repeated ``length``-byte string.

Suffixes are taken at anchors only. The anchor of a ``length``-byte window is its ``gram``-byte substring of least
fingerprint, the leftmost of equals, so equal windows have equal anchors at equal offsets. Windows that follow each other
and share an anchor are a run; its context is the bytes they cover. A batch's suffix array has one entry for each anchored
context: (fingerprint of the gram, fingerprint of the context, number of runs), in that order. On average a run covers
over a hundred windows, so the arrays are a small part of the text.

A new batch's array is merge-scanned against every level for entries that share a gram, and joins the levels as in a
binary counter: with a level of equal rank it is merged into one of the next rank, and so on. The scans yield

* contexts that occur twice or more: all windows of their runs are repeated;
* grams with several contexts: there matches begin or end inside a run. The windows of these runs alone are compared one
  by one, by fingerprint (``exchange``).

Every pair of equal windows has the same anchor gram, so it is met in one of the two ways and nothing is missed.
Fingerprints are 64 bits (128 for contexts); no bytes are compared, so a false match has a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm import bytescan, exchange
from fieldbook.llm.common import Workspace, small

U = np.uint64
LENGTH = 400
GRAM = 128
BATCHES = 4


def _anchored(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Row, first window (in its row), number of windows, gram and context fingerprints of every run."""
    prints = bytescan.Prints(data)
    grams = prints.windows(gram)
    key = (grams & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=U)
    anchor = (bytescan.sliding_min(key, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offs, start, "right") - 1
    at = np.flatnonzero(start + length <= offs[row + 1])
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (np.diff(at) != 1)
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(at)))
    p = at[i]
    return row[p], p - offs[row[p]], n, grams[anchor[p]], prints(p, p + n - 1 + length)


def suffix_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, start, n, gram, context) of every run of the (key, text) rows."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in bytescan.chunks(b.column(1)):
                row, start, n, g, c = _anchored(data, offs, length, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo + row]), pa.array(start), pa.array(n.astype(np.int32)),
                         pa.array(g.view(np.int64)), pa.array(c.view(np.int64))],
                        names=["key", "start", "n", "gram", "context"])

    return docs.select("key", "text").mapInArrow(run, "key long, start long, n int, gram long, context long")


class SuffixIndex:
    """Levels of suffix arrays; level r holds 2**r batches. ``add`` returns nothing: matches gather in the two hit tables."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.whole, self.open = ws, {}, [], []

    def add(self, runs: DataFrame) -> None:
        array = runs.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"))
        rank, gone = 0, []
        while rank in self.levels:  # the carry of a binary counter, as one merge of all its levels
            gone.append(self.levels.pop(rank))
            array = array.unionByName(gone[-1])
            rank += 1
        if gone:
            array = array.groupBy("gram", "context").agg(F.sum("n").alias("n"))
        array = self.ws.keep(array.sortWithinPartitions("gram", "context"))
        for level in gone:
            self.ws.drop(level)
        self._scan(array)
        for other in self.levels.values():
            self._scan(array, other)
        self.levels[rank] = array

    def _scan(self, array: DataFrame, other: DataFrame | None = None) -> None:
        """Note the contexts met twice and the grams met in several contexts, in one array or across two."""
        both = array
        if other is not None:
            near = array.select("gram").distinct()
            both = array.unionByName(other.join(near, "gram", "left_semi"))
        if other is None:
            self.whole.append(both.where("n > 1").select("gram", "context"))
        else:
            self.whole.append(self.ws.keep(array.select("gram", "context").join(other, ["gram", "context"], "left_semi")))
        several = both.groupBy("gram").agg(F.min("context").alias("lo"), F.max("context").alias("hi"))
        self.open.append(self.ws.keep(several.where("lo < hi").select("gram")))
        if other is None:
            self.whole[-1] = self.ws.keep(self.whole[-1])

    def hits(self) -> tuple[DataFrame, DataFrame]:
        whole, grams = self.whole[0], self.open[0]
        for x in self.whole[1:]:
            whole = whole.unionByName(x)
        for x in self.open[1:]:
            grams = grams.unionByName(x)
        return self.ws.keep(whole.distinct()), self.ws.keep(grams.distinct())


def _post_windows(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Fingerprints of the windows of the runs listed with each (key, text, runs)."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).view(U)
            lists = b.column(2)
            for lo, hi, data, offs in bytescan.chunks(b.column(1)):
                prints = bytescan.Prints(data)
                own = lists.slice(lo, hi - lo)
                count = np.fromiter((len(x) for x in own), dtype=np.int64, count=hi - lo)
                flat = own.flatten()
                start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
                row = np.repeat(np.arange(hi - lo), count)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, pos = np.repeat(row, n), np.repeat(start, n) + step
                if len(pos):
                    at = offs[row] + pos
                    yield exchange.post(keys[lo:hi][row], prints(at, at + length), pos, parts)

    return docs.select("key", "text", "runs").mapInArrow(run, exchange.POSTED)


def _spans(runs, items, length: int) -> list[tuple[int, int]]:
    """Maximal covered ranges from runs of windows and packed single windows."""
    start = [r["start"] for r in runs]
    last = [r["start"] + r["n"] - 1 for r in runs]
    single = np.frombuffer(b"".join(items), dtype="<u4").astype(np.int64)
    start = np.concatenate([np.array(start, dtype=np.int64), single])
    end = np.concatenate([np.array(last, dtype=np.int64), single]) + length
    if not len(start):
        return []
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.append(at[1:] - 1, len(end) - 1)].tolist()))


OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _cut(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            text = b.column(1)
            out = []
            for i, runs, items in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                spans = _spans(runs.as_py() or [], items.as_py() or [], length)
                raw = text[len(out)].as_buffer() if text[len(out)].is_valid else b""
                raw, digest, pieces, at = memoryview(raw or b""), hashlib.sha256(), [], 0
                for s, e in [*spans, (len(raw), len(raw))]:
                    digest.update(raw[at:s])
                    if with_text:
                        pieces.append(bytes(raw[at:s]))
                    at = e
                out.append((i, len(raw), sum(e - s for s, e in spans), len(spans), digest.hexdigest(),
                            [{"start": s, "end": e} for s, e in spans], b"".join(pieces) if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[
                    "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.mapInArrow(run, OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, and kept (bytes; null
    without ``with_text``). Spans are byte ranges, end exclusive.

    Null and empty texts, and texts shorter than ``length``, lose nothing. Rows that repeat a whole text of ``length``
    bytes or more lose all of it, each of them. What is left may be no valid UTF-8 where a cut falls inside a character.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixes")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "key", F.xxhash64("id", "text"))
    runs = ws.keep(suffix_runs(keyed, length, gram).withColumn("batch", F.expr(f"pmod(key, {batches})").cast("int")), "batch")
    index = SuffixIndex(ws)
    for i in range(batches):
        index.add(runs.where(F.col("batch") == i))
    whole, grams = index.hits()
    hit = (runs.join(small(whole.withColumn("whole", F.lit(True))), ["gram", "context"], "left")
           .join(small(grams.withColumn("open", F.lit(True))), "gram", "left").where("whole or open"))
    hit = ws.keep(hit.select("key", "start", "n", "gram", "context", "whole", "open"))
    once = (hit.where("whole and open").groupBy("gram", "context").agg(F.min(F.struct("key", "start", "n")).alias("r"))
            .select("r.*"))
    unsure = ws.keep(hit.where("open and whole is null").select("key", "start", "n").unionByName(once)
                     .groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"),
                                         F.sum("n").alias("windows")))
    parts = exchange.buckets(unsure.agg(F.sum("windows")).first()[0] or 0)
    posted = _post_windows(keyed.join(small(unsure.select("key", "runs"), 200_000), "key"), length, parts)
    single = exchange.answers(posted, parts).select(F.col("owner").alias("key"), F.lit(None).cast("long").alias("start"),
                                                    F.lit(None).cast("int").alias("n"), "items")
    covered = hit.where("whole").select("key", "start", "n", F.lit(None).cast("binary").alias("items")).unionByName(single)
    run = F.when(F.col("n").isNotNull(), F.struct("start", "n"))
    spans = ws.keep(covered.groupBy("key").agg(F.collect_list(run).alias("runs"), F.collect_list("items").alias("items")))
    cut = keyed.join(spans.hint("shuffle_hash"), "key", "left").select("id", "text", "runs", "items")
    return _cut(cut, length, with_text)
