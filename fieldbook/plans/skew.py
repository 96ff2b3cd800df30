"""Joins on keys of which one may hold a third of the rows."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_counts(df: DataFrame, keys: Sequence[str], rows_per_split: int) -> DataFrame:
    """Keys with more than ``rows_per_split`` rows and the number of splits each needs.

    At most rows / rows_per_split keys can qualify, so the result stays small whatever the data.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > rows_per_split)
            .select(*keys, F.ceil(F.col("__n") / F.lit(rows_per_split)).cast("int").alias("__splits")))


def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __nl, __nr): each key's rows on either side. Null keys meet nothing."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*keys, one.alias("__l"), none.alias("__r")).unionByName(right.select(*keys, none.alias("__l"), one.alias("__r")))
    return both.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum("__l").alias("__nl"), F.sum("__r").alias("__nr"))


def block_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int, pairs: int) -> DataFrame:
    """Keys whose join needs more than one task, with the number of blocks of each side (__ls, __rs).

    A key is cut into as many blocks as keep each under ``rows`` rows of either side and ``pairs`` pairs; how many of them
    fall on which side is what repeats the fewest rows. A key counts as hot only with over ``rows`` rows or the square
    root of ``pairs``, so the hot keys are few whatever the data.
    """
    nl, nr = F.col("__nl"), F.col("__nr")
    work = nl.cast("double") * nr
    n = _sides(left, right, keys).where((nl > 0) & (nr > 0) & ((nl > rows) | (nr > rows) | (work > pairs)))
    blocks = F.ceil(F.greatest(work / pairs, F.lit(1.0)))
    ls = F.greatest(F.ceil(nl / F.lit(rows)), F.round(F.sqrt(blocks * nl / nr)).cast("long"), F.lit(1))
    rs = F.greatest(F.ceil(nr / F.lit(rows)), F.ceil(blocks / ls), F.lit(1))
    return n.select(*keys, ls.cast("int").alias("__ls"), rs.cast("int").alias("__rs"))


def row_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], left_rows: int, right_rows: int) -> DataFrame:
    """Keys with more rows of a side than a task should hold, with the number of blocks of each side (__ls, __rs)."""
    nl, nr = F.col("__nl"), F.col("__nr")
    n = _sides(left, right, keys).where((nl > 0) & (nr > 0) & ((nl > left_rows) | (nr > right_rows)))
    return n.select(*keys, F.ceil(nl / F.lit(left_rows)).cast("int").alias("__ls"), F.ceil(nr / F.lit(right_rows)).cast("int").alias("__rs"))


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block they fall into (__lb, __rb): rows of a ``hot`` key meet every block of the other side once."""
    part = lambda n, *c: F.when(F.col(n).isNotNull(), F.pmod(F.xxhash64(*c), F.col(n).cast("long"))).otherwise(F.lit(0).cast("long"))
    fill = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)).cast("long") - 1))
    plain = [f.name for f in right.schema.fields if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    l = left.join(hot, list(keys), "left").withColumn("__lb", part("__ls", *salt_by)).withColumn("__rb", fill("__rs")).drop("__ls", "__rs")
    r = right.join(hot, list(keys), "left").withColumn("__rb", part("__rs", *plain)).withColumn("__lb", fill("__ls")).drop("__ls", "__rs")
    return l, r


PAIRS_PER_TASK = 5_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                how: str = "inner", rows_per_split: int = 100_000, pairs_per_split: int = PAIRS_PER_TASK) -> DataFrame:
    """Equi join in which a key with many rows on either side, or on both, is spread over several tasks.

    Hot keys are found by one count of both sides. Their left rows fall into blocks by a hash of ``salt_by``, their right rows
    by a hash of all they hold (a retry gives the same blocks), and every block of the one side meets every block of the
    other. Every pair is met exactly once. A left join spreads its left side only.

    Where the count finds more pairs than one task should meet, both sides are dealt over as many tasks as the pairs ask
    for: the bytes of the sides, by which Spark merges tasks or broadcasts a side, say nothing of the pairs.
    """
    if how == "left":
        return _left_salted(left, right, keys, salt_by, rows_per_split)
    if how != "inner":
        raise ValueError("salted_join supports inner and left joins")
    hot = block_counts(left, right, keys, rows_per_split, pairs_per_split)
    l, r = dealt(left, right, keys, salt_by, hot)
    on = [*keys, "__lb", "__rb"]
    tasks = math.ceil(pair_count(left, right, keys) / pairs_per_split)
    if tasks > 1:
        tasks = min(MOST_TASKS, max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        l, r = l.repartition(tasks, *on), r.repartition(tasks, *on).hint("merge")
    return l.join(r, on).drop("__lb", "__rb")


MOST_TASKS = 20_000


def pair_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> float:
    """How many pairs of rows meet on ``keys``, counted without meeting them."""
    return _sides(left, right, keys).agg(F.sum(F.col("__nl").cast("double") * F.col("__nr"))).first()[0] or 0.0


def _left_salted(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str], rows_per_split: int) -> DataFrame:
    hot = split_counts(left, keys, rows_per_split)
    l = left.join(hot, list(keys), "left").withColumn(
        "__salt", F.when(F.col("__splits").isNotNull(),
                         F.pmod(F.xxhash64(*salt_by), F.col("__splits").cast("long"))).otherwise(F.lit(0).cast("long"))
    ).drop("__splits")
    r = right.join(hot, list(keys), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__splits"), F.lit(1)).cast("long") - 1))
    ).drop("__splits")
    return l.join(r, [*keys, "__salt"], "left").drop("__salt")
