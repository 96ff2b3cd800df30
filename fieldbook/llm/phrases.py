"""Collocations from depth-truncated suffix subtrees, partitioned vertically by word prefixes under a memory budget.

Texts are read as pieces of words, and every word position begins a suffix that is cut at ``DEPTH`` words. The suffixes of
the whole corpus make a trie; it is never built at once.

1. *Words.* Every (lang, word) is counted; a word is known by a 64-bit key from then on. Should two words share a key, which
   the count shows, all is done again with another salt. Words below the threshold can't be part of a candidate, so suffixes
   end before them (a fixed-size bitmap tells the tasks, which at worst lets a rare word pass).
2. *Vertical partitioning.* Prefixes of one word are packed into groups whose occurrences fit ``GROUP_SUFFIXES``. A prefix
   that is beyond that alone is extended to two words, these are counted in a scan of their own, and packed likewise; one
   that is still beyond the budget is dealt by all three. Prefixes are known by hash bins, so that the plan for the tasks
   has a fixed size whatever the vocabulary.
3. *Subtrees.* Each task sends its suffixes merged into small tries, one for each group; a group merges its tries by itself
   and reads counts from the totals of its leaves.

A hot word or phrase is thus at most one entry a chunk, and its subtree is spread over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm import bytescan
from fieldbook.llm.common import Workspace, small
from fieldbook.plans.skew import salted_join

U = np.uint64
LEAST = 10
TOP = 2000
DEPTH = 3
GROUP_SUFFIXES = 2_500_000
CHUNK_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20  # positions merged at once, so that three local word numbers fit 63 bits
BIN_BITS = 18  # prefixes are packed as 2**18 bins at most
RARE_BITS = 24
LOOKUP_ROWS = 100_000  # of a table that is broadcast: several of them meet in one plan, and the driver holds each
_BITMAP = 4096 * 8  # bits of one row of Spark's bitmap aggregate
_A, _B, _C = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_PIECE_ENDS = np.zeros(256, dtype=bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE_ENDS.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

TRIES = "grp int, w1 binary, n1 binary, w2 binary, n2 binary, w3 binary, n3 binary"
NODES = "k1 long, k2 long, k3 long, a long"


def _read(data: np.ndarray, offs: np.ndarray, lang: np.ndarray, salt: int):
    """Lowered bytes; start, end and row of every word; its key; and whether it goes on the piece of the word before."""
    low = _LOWER[data]
    inside = ~_GAP[low]
    n = len(low)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return low, e, e, e, e.astype(U), e.astype(bool)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | first[:n]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    row = np.searchsorted(offs, start, "right") - 1
    prints = bytescan.Prints(low)(start, end)
    key = bytescan.mix(prints + bytescan.mix(lang[row] + U(salt) * _B))
    key[key == 0] = U(1)  # zero stands for "no word"
    ends = np.cumsum(_PIECE_ENDS[low], dtype=np.int32)[start]
    joined = np.zeros(len(start), dtype=bool)
    joined[1:] = (row[1:] == row[:-1]) & (ends[1:] == ends[:-1])
    return low, start, end, row, key, joined


def _chunks(batches) -> Iterator[tuple]:
    """(row columns, first row, last row, bytes, offsets) of the (text, lang hash, lang) batches."""
    for b in batches:
        for lo, hi, data, offs in bytescan.chunks(b.column(0), CHUNK_BYTES):
            yield b, lo, hi, data, offs


def word_counts(texts: DataFrame, salt: int) -> DataFrame:
    """(key, lang_key, lang, word, n), summed up by chunk."""

    def run(batches):
        for b, lo, hi, data, offs in _chunks(batches):
            lang = b.column(1).to_numpy(zero_copy_only=False)[lo:hi].view(U)
            low, start, end, row, key, _ = _read(data, offs, lang, salt)
            if not len(key):
                continue
            uniq, at, n = np.unique(key, return_index=True, return_counts=True)
            size = (end - start)[at]
            ends = np.cumsum(size)
            raw = low[np.repeat(start[at] - ends + size, size) + np.arange(ends[-1])]
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                                                     pa.py_buffer(raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uniq.view(np.int64)), pa.array(lang[row[at]].view(np.int64)),
                 b.column(2).take(pa.array(lo + row[at])), words.cast(pa.string()), pa.array(n)],
                names=["key", "lang_key", "lang", "word", "n"])

    return texts.mapInArrow(run, "key long, lang_key long, lang string, word string, n long")


class Plan:
    """How suffixes are dealt: the bitmap of frequent words, and a group for each bin of one- and two-word prefixes.

    ``deep`` bins of two-word prefixes span several groups, from their first one on.
    """

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        none = np.zeros(1 << BIN_BITS, dtype=np.int32)
        self.one, self.two, self.span, self.groups, self.deep_from = none - 1, none - 1, none, 0, 0
        self.extended = np.zeros(1 << BIN_BITS, dtype=bool)

    @staticmethod
    def _packed(count: np.ndarray, budget: int, first: int) -> tuple[np.ndarray, int]:
        """Next-fit in bin order of the bins within the budget; others and empty ones get -1."""
        group, fill, out = first, 0, np.full(len(count), -1, dtype=np.int32)
        for i in np.flatnonzero((count > 0) & (count <= budget)).tolist():
            if fill + count[i] > budget and fill:
                group, fill = group + 1, 0
            out[i] = group
            fill += count[i]
        return out, group + 1 if fill else first

    def pack_one(self, count: np.ndarray, budget: int) -> None:
        self.one, self.groups = self._packed(count, budget, 0)
        self.extended = count > budget

    def pack_two(self, count: np.ndarray, budget: int) -> None:
        self.two, self.groups = self._packed(count, budget, self.groups)
        self.deep_from = self.groups
        self.span = np.where(count > budget, -(-count // budget), 0).astype(np.int32)
        self.two = np.where(self.span > 0, self.groups + np.cumsum(self.span) - self.span, self.two).astype(np.int32)
        self.groups += int(self.span.sum())

    def known(self, key: np.ndarray) -> np.ndarray:
        """Whether a key may be a frequent word's."""
        bit = (key & U((1 << RARE_BITS) - 1)).astype(np.int64)
        return (self.frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def group(self, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
        out = self.one[_bin(k1)]
        far = np.flatnonzero(self.extended[_bin(k1)])
        if len(far):
            b = _bin(_pair(k1[far], k2[far]))
            span = np.maximum(self.span[b], 1).astype(U)
            out[far] = self.two[b] + (bytescan.mix(_pair(k1[far], k2[far]) + k3[far] * _C) % span).astype(np.int32)
        return out


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BIN_BITS)).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytescan.mix(a * _A + b * _B)


def _suffixes(key: np.ndarray, joined: np.ndarray, plan: Plan):
    """Second and third word of each position's suffix, 0 where it ends before; and the positions of two words or more."""
    fine = plan.known(key)
    goes = np.zeros(len(key) + 2, dtype=bool)
    goes[1:len(key)] = joined[1:] & fine[1:] & fine[:-1]
    second = np.append(key[1:], U(0)) * goes[1:len(key) + 1]
    third = np.append(key[2:], np.zeros(min(2, len(key)), dtype=U))[:len(key)] * (goes[1:len(key) + 1] & goes[2:len(key) + 2])
    return second, third, np.flatnonzero(second)


def _second_words(texts: DataFrame, plan, salt: int) -> DataFrame:
    """(bin, n): occurrences by bin of two-word prefixes, of the first words that are extended; once a task."""

    def run(batches):
        p, total = plan.value, np.zeros(1 << BIN_BITS, dtype=np.int64)
        for b, lo, hi, data, offs in _chunks(batches):
            *_, key, joined = _read(data, offs, b.column(1).to_numpy(zero_copy_only=False)[lo:hi].view(U), salt)
            second, _, at = _suffixes(key, joined, p)
            at = at[p.extended[_bin(key[at])]]
            total += np.bincount(_bin(_pair(key[at], second[at])), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bin", "n"])

    return texts.mapInArrow(run, "bin int, n long")


def _tries(texts: DataFrame, plan, salt: int) -> DataFrame:
    """One trie for each chunk and group, level by level: keys, and the number of children or, at the leaves, the count."""

    def merged(key, second, third, at):
        """Distinct suffixes and their counts, in the order of their keys."""
        uniq, local = np.unique(np.concatenate([key[at], second[at], third[at]]), return_inverse=True)
        local = local.reshape(3, -1).astype(U)
        packed, n = np.unique((local[0] << U(42)) | (local[1] << U(21)) | local[2], return_counts=True)
        mask = U((1 << 21) - 1)
        return *(uniq[((packed >> U(s)) & mask).astype(np.int64)] for s in (42, 21, 0)), n

    def run(batches):
        p = plan.value
        for b, lo, hi, data, offs in _chunks(batches):
            *_, key, joined = _read(data, offs, b.column(1).to_numpy(zero_copy_only=False)[lo:hi].view(U), salt)
            second, third, at = _suffixes(key, joined, p)
            for i in range(0, len(at), BLOCK_WORDS // 2):
                part = at[i:i + BLOCK_WORDS // 2]
                yield _packed(p, *merged(key, second, third, part))

    def _packed(p, k1, k2, k3, n):
        group = p.group(k1, k2, k3)
        by = np.argsort(group, kind="stable")
        by = by[np.searchsorted(group[by], 0):]  # the bins without a group hold no frequent word
        group, k1, k2, k3, n = group[by], k1[by], k2[by], k3[by], n[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        rows = np.flatnonzero(new)
        new[1:] |= k1[1:] != k1[:-1]
        ones = np.flatnonzero(new)
        new[1:] |= k2[1:] != k2[:-1]
        twos = np.flatnonzero(new)
        of_one, of_two = np.searchsorted(ones, rows), np.searchsorted(twos, rows)
        kids1 = np.diff(np.append(np.searchsorted(twos, ones), len(twos))).astype("<u4")
        kids2 = np.diff(np.append(twos, len(by))).astype("<u4")
        w1, w2, n = k1[ones], k2[twos], n.astype("<u4")
        cols = [[] for _ in range(6)]
        for a, b, c, d, e, f in zip(of_one, np.append(of_one[1:], len(ones)), of_two, np.append(of_two[1:], len(twos)),
                                    rows, np.append(rows[1:], len(by))):
            for col, x in zip(cols, (w1[a:b], kids1[a:b], w2[c:d], kids2[c:d], k3[e:f], n[e:f])):
                col.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(group[rows]), *[pa.array(c, pa.binary()) for c in cols]],
                                          names=["grp", "w1", "n1", "w2", "n2", "w3", "n3"])

    return texts.mapInArrow(run, TRIES)


def _leaves(tries: DataFrame, deep_from: int, least: int) -> DataFrame:
    """(k1, k2, k3, a): the nodes of two (k3 null) and three words that reach ``least``. Of a group that holds a part of a
    two-word prefix only, such prefixes come with whatever they have there."""

    def joined(col: pa.ChunkedArray, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in col), dtype=kind)

    def merge(group: pa.Table) -> pa.Table:
        least_two = 1 if group.column("grp")[0].as_py() >= deep_from else least
        w1, n1, w2, n2, k3, n = (joined(group.column(c), k) for c, k in zip(group.column_names[1:], ["<u8", "<u4"] * 3))
        k1, k2 = np.repeat(np.repeat(w1, n1), n2), np.repeat(w2, n2)
        by = np.lexsort((k3, k2, k1))
        k1, k2, k3, n = k1[by], k2[by], k3[by], n[by].astype(np.int64)
        new = np.ones(len(by), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        twos = np.flatnonzero(new)
        new[1:] |= k3[1:] != k3[:-1]
        threes = np.flatnonzero(new)
        leaf, node = np.add.reduceat(n, threes), np.add.reduceat(n, twos)
        threes, leaf = threes[(leaf >= least) & (k3[threes] > 0)], leaf[(leaf >= least) & (k3[threes] > 0)]
        twos, node = twos[node >= least_two], node[node >= least_two]
        at = np.concatenate([twos, threes])
        third = pa.array(k3[at].view(np.int64), mask=np.arange(len(at)) < len(twos))
        return pa.table({"k1": pa.array(k1[at].view(np.int64)), "k2": pa.array(k2[at].view(np.int64)), "k3": third,
                         "a": pa.array(np.concatenate([node, leaf]))})

    return tries.groupBy("grp").applyInArrow(merge, NODES)


def _frequent_bits(words: DataFrame) -> np.ndarray:
    """A bitmap of the frequent words' keys, of fixed size: 2**RARE_BITS bits from at most as many / 32,768 rows."""
    at = F.expr(f"key & {(1 << RARE_BITS) - 1}")
    rows = (words.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
            .agg(F.bitmap_construct_agg(F.expr("at & 32767")).alias("bits")).collect())
    out = np.zeros(1 << (RARE_BITS - 3), dtype=np.uint8)
    for r in rows:
        out[r["part"] * _BITMAP // 8:(r["part"] + 1) * _BITMAP // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _histogram(counted: DataFrame) -> np.ndarray:
    out = np.zeros(1 << BIN_BITS, dtype=np.int64)
    got = counted.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return out


def phrase_counts(docs: DataFrame, ws: Workspace, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  budget: int = GROUP_SUFFIXES, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """(words, nodes): (key, lang_key, lang, word, n) of all words, and (k1, k2, k3, a) of all phrases of two words (k3
    null) and three that come ``least`` times or more."""
    sc = docs.sparkSession.sparkContext
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    while True:
        texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).cast("string").alias("text"),
                                                          F.xxhash64(lang, F.lit(salt)).alias("lang_key"), lang.alias("lang"))
        words = ws.keep(word_counts(texts, salt).groupBy("key", "lang_key", "lang", "word").agg(F.sum("n").alias("n")))
        if not words.groupBy("key").count().where("count > 1").limit(1).count():
            break
        ws.drop(words)
        salt += 1
    often = words.where(F.col("n") >= least)
    plan = Plan(_frequent_bits(often))
    top = F.expr(f"cast(shiftrightunsigned(key, {64 - BIN_BITS}) as int)")
    plan.pack_one(_histogram(often.select(top.alias("bin"), "n")), budget)
    if plan.extended.any():
        plan.pack_two(_histogram(_second_words(texts, sc.broadcast(plan), salt)), budget)
    else:
        plan.deep_from = plan.groups
    nodes = ws.keep(_leaves(_tries(texts, sc.broadcast(plan), salt), plan.deep_from, least))
    two = nodes.where("k3 is null").groupBy("k1", "k2").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, two.select("k1", "k2", F.lit(None).cast("long").alias("k3"), "a").unionByName(nodes.where("k3 is not null"))


def _lookup(ws: Workspace, df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join to a table of one narrow row a key; a key that many rows of ``df`` share is spread, by ``df`` as kept."""
    marked = small(table, LOOKUP_ROWS)
    if marked is not table:
        return df.join(marked, keys)
    return salted_join(ws.keep(df), table, keys, [c for c in ("k1", "k2", "k3") if c in df.columns and c not in keys] or keys)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 swallowed: int = 50, budget: int = GROUP_SUFFIXES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    A phrase counts ``least`` times or more; its score is floor(10^6 a^2 / (l r)) at its weakest cut (the first of equals),
    in exact arithmetic. A phrase inside a longer one that holds ``swallowed`` percent of its occurrences is left out.
    A null lang is ``und``. Null and empty texts have no words; repeated rows count each; a text of any length is read
    whole. Ties go by a, then by the phrase's bytes. Empty tables give no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    words, nodes = phrase_counts(docs, ws, text_col, lang_col, least, budget)
    nodes = ws.keep(nodes)
    freq = ws.keep(words.where(F.col("n") >= least).select("key", "n", "lang_key"))
    two = nodes.where("k3 is null").select("k1", "k2", "a")
    three = nodes.where("k3 is not null")

    def freq_of(k, name, lang=False):
        return freq.select(F.col("key").alias(k), F.col("n").alias(name), *(["lang_key"] if lang else []))

    longer = (three.select("k1", "k2", "a").unionByName(three.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "a"))
              .groupBy("k1", "k2").agg(F.max("a").alias("longer")))
    alone = two.join(longer, ["k1", "k2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < swallowed * F.col("a")))
    pairs = _lookup(ws, _lookup(ws, alone, freq_of("k1", "l", True), ["k1"]), freq_of("k2", "r"), ["k2"])
    pairs = pairs.select("lang_key", "k1", "k2", F.lit(None).cast("long").alias("k3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    triples = _lookup(ws, _lookup(ws, three, freq_of("k1", "f1", True), ["k1"]), freq_of("k3", "f3"), ["k3"])
    triples = _lookup(ws, triples, two.withColumnRenamed("a", "f12"), ["k1", "k2"])
    triples = _lookup(ws, triples, two.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("a").alias("f23")), ["k2", "k3"])
    cut1, cut2 = _score("a", "f1", "f23"), _score("a", "f12", "f3")
    triples = triples.select("lang_key", "k1", "k2", "k3", "a", F.when(cut1 <= cut2, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                             F.when(cut1 <= cut2, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least(cut1, cut2).alias("score"))
    place = F.rank().over(Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a")))
    best = ws.keep(pairs.unionByName(triples).withColumn("place", place).where(F.col("place") <= top).drop("place"))
    names = words.where(F.col("n") >= least)
    for k in ("k1", "k2", "k3"):
        asked = best.select(k).where(f"{k} is not null").distinct()
        named = names.join(small(ws.keep(asked)), F.col("key") == F.col(k)).select(k, F.col("word").alias("w" + k[1]))
        best = best.join(named, k, "left")
    total = words.groupBy("lang_key", "lang").agg(F.sum("n").alias("n"))
    best = best.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    rank = F.row_number().over(Window.partitionBy("lang_key").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (best.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "lang_key")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _score(a: str, l: str, r: str):
    """floor(10^6 a a / (l r)); the products have up to 38 digits."""
    return F.expr(f"cast((cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) "
                  f"div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as bigint)")
