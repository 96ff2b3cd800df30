"""Benchmark decontamination by spaced seeds: masks that ignore some token positions find overlaps that hold substitutions.

Tokens are runs of letters and digits, lower-cased. A mask lays a pattern of cared-for positions over each window of
tokens; the cared-for ones are hashed, for training texts and benchmark items alike, and equal hashes are hits. The masks
are all those of three cared-for positions up to a span at which no alignment that counts can be without a hit (see
``family``), wherever its substitutions lie. A hit places the item over the document, at one offset; the item's tokens are
then compared at that offset, all of them, and an alignment counts if enough agree. So a chance hit on common words alone
is dismissed. A passage of an item counts by itself if it is long enough, and an item that extra, missing or differently
cut tokens break into pieces is summed over the offsets of its pieces. DataFrame functions only.

Benchmark seeds are broadcast behind a count of them; beyond it the join is a shuffle. A seed that stands in very many
items or texts multiplies neither side: items are met once for each distinct (document, item, offset).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import Workspace, small

WEIGHT = 3  # cared-for positions of a mask
SHARE = 0.5
MIN_TOKENS = 8
QUOTE, QUOTE_SPAN = 13, 16  # a passage: so many agreeing tokens among so many consecutive ones of an item
QUOTE_HITS = 3  # hits of one offset that any passage has at least
SEED_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and blank texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def family(share: float = SHARE, min_tokens: int = MIN_TOKENS) -> tuple[tuple[int, ...], ...]:
    """The masks, as cared-for positions from 0, of which every alignment of at least ``share`` of an item's tokens, and
    ``min_tokens`` of them, holds one at least.

    Of m agreeing positions among n tokens, m - 1 gaps sum to n - 1 at most. They make q disjoint runs of weight - 1 gaps;
    the rest are 1 or more. So some run spans no more than the mean of what is left to them, and no gaps do worse.
    """
    most = max(min_tokens, 1)
    run = min(WEIGHT, most) - 1
    if not run:
        return ((0,),)
    # beyond so many agreeing tokens the bound stays at its limit, run / share
    span = max((int(m / share) - m + (m - 1) // run * run) // ((m - 1) // run) for m in range(most, most + 1000))
    return tuple((0, *inner, last) for last in range(run, span + 1) for inner in combinations(range(1, last), run - 1))


def _exploded(rows: DataFrame, name: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(name, at, seed) for each row's array of token hashes ``w``: every mask laid at every position."""
    ahead = sorted({i for mask in masks for i in mask})
    near = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in ahead])
    out = rows.select(name, F.posexplode(near).alias("at", "t")).select(name, "at", *[F.col(f"t.w{i}").alias(f"w{i}") for i in ahead])
    seed = [F.when(F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(salt), *[F.col(f"w{i}") for i in mask])) for salt, mask in enumerate(masks)]
    return out.select(name, "at", F.explode(F.array(*seed)).alias("seed")).where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", share: float = SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, item_id, offset, matched, item_tokens): where a document holds an item, ``offset`` being where the item's first
    token falls in the document. One of three holds:

    - at least ``share`` of the item's tokens, and ``min_tokens`` of them, stand in the same places, counted from
      ``offset``; none of these is missed, whichever tokens are substituted;
    - ``QUOTE`` tokens of ``QUOTE_SPAN`` consecutive ones of the item do, however long the item is;
    - for a document and item of which neither holds: that many different tokens of the item stand in seed hits at
      ``offset`` or at up to half the item's length beyond it. One row of the pair, where most do; ``matched`` counts them.

    An item cut off at either end of a document is counted against its whole. Items of fewer than ``min_tokens`` can't be
    found. Null texts have no tokens; rows with a null id are left out. Rows that repeat an id are compared one by one,
    equal findings are returned once. Either table may be empty; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "decontamination")
    masks = family(share, min_tokens)
    words = lambda c: F.transform(tokens(F.col(c)), lambda w: F.xxhash64(w))
    items = ws.keep(bench.select(F.col(item_col).alias("item_id"), words(item_text_col).alias("w")).where(F.size("w") > 0))
    index = ws.keep(_exploded(items, "item_id", masks).select("item_id", F.col("at").alias("item_at"), "seed").distinct())
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = ws.keep(_exploded(texts.select("id", words("text").alias("w")), "id", masks).join(small(index, SEED_ROWS), "seed")
                   .groupBy("id", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.count(F.lit(1)).alias("hits")))
    # a pair with fewer hits than any finding has can't be one
    size = ws.keep(items.groupBy("item_id").agg(F.min(F.size("w")).alias("n")))
    span, m = max(mask[-1] for mask in masks), F.greatest(F.lit(min_tokens), F.ceil(F.col("n") * share))
    alone = F.ceil(((span + 1) * (m - 2) - 2 * (F.col("n") - 2)) / (span - 1)) if len(masks[0]) == 3 else F.lit(1)
    pairs = hits.groupBy("id", "item_id").agg(F.max("hits").alias("top"), F.sum("hits").alias("all")).join(small(size), "item_id")
    pairs = pairs.where((F.col("top") >= F.least(alone, F.lit(QUOTE_HITS))) | (F.col("all") * len(masks[0]) >= m)).select("id", "item_id")
    hits = ws.keep(hits.drop("hits").join(small(ws.keep(pairs)), ["id", "item_id"], "left_semi"))
    placed = hits.join(small(items.withColumnRenamed("w", "v")), "item_id")
    seen = texts.join(small(hits.select("id").distinct()), "id", "left_semi").select("id", words("text").alias("w"))
    both = seen.join(placed, "id")
    at = F.sequence(F.lit(0), F.size("v") - 1)
    same = F.transform(at, lambda i: ((F.col("offset") + i >= 0) & F.get("w", F.col("offset") + i).eqNullSafe(F.get("v", i))).cast("int"))
    compared = both.select("id", "item_id", "offset", F.xxhash64("w", "v").alias("pair"), F.size("v").alias("n"), same.alias("same"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - QUOTE_SPAN, F.lit(0)))
    quote = F.exists(starts, lambda i: total(F.slice("same", i + 1, QUOTE_SPAN)) >= QUOTE)
    # positions of the item that stand in a seed hit at this offset
    each = F.sequence(F.lit(0), F.col("n") - 1)
    laid = [F.filter(each, lambda i: reduce(and_, [F.get("same", i + j).eqNullSafe(1) for j in mask])) for mask in masks]
    places = [F.transform(where, lambda i: i + j) for where, mask in zip(laid, masks) for j in mask]
    judged = compared.select("id", "item_id", "pair", "offset", "n", total(F.col("same")).alias("matched"), quote.alias("quote"),
                             F.array_distinct(F.concat(*places)).alias("held"))
    enough = lambda c: (F.col(c) >= min_tokens) & (F.col(c) >= F.col("n") * share)
    judged = ws.keep(judged.withColumn("alone", F.col("quote") | enough("matched")))
    pieces = judged.groupBy("id", "item_id", "pair", "n").agg(
        F.max("alone").alias("alone"), F.sum(F.size("held")).alias("most"), F.collect_set(F.struct("offset", "held")).alias("parts"))
    joined = lambda o: F.size(F.array_distinct(F.flatten(F.transform(F.filter(
        "parts", lambda p: (p["offset"] >= o) & (p["offset"] <= o + F.col("n") / 2)), lambda p: p["held"]))))
    best = F.array_max(F.transform("parts", lambda p: F.struct(joined(p["offset"]).alias("matched"), (-p["offset"]).alias("back"))))
    split = (pieces.where(~F.col("alone") & enough("most")).withColumn("best", best)
             .select("id", "item_id", (-F.col("best.back")).alias("offset"), F.col("best.matched").alias("matched"), "n").where(enough("matched")))
    out = judged.where("alone").select("id", "item_id", "offset", "matched", "n").unionByName(split)
    return out.select("id", "item_id", "offset", F.col("matched").cast("long").alias("matched"), F.col("n").cast("long").alias("item_tokens")).distinct()
