"""Temperature mixing: source shares to the power of an exponent, and the rows that realise them.

Weights are token shares raised to an exponent and made to sum to one: 1 keeps the corpus as it is, 0 makes all sources
equal. The exponent is bisected to the least one that respects a repetition limit, or meets a target entropy. The weights
are then realised as whole and partial passes over each source: with the budget given (or the least one that every source
meets with one pass), a source has so many tokens to deliver, as passes, each in a permutation of its own. Permutations
are dealt in blocks: a block is a range of the permutation's hash, and whole blocks are taken until the last one, of which
the first rows are. Nothing is dropped to fit: a source's last pass ends with the row that meets its budget.

Sources may be many and one may hold a third of all rows: the bisection needs the largest and the smallest source, or, for an
entropy, a sum over the source table at each step; blocks hold a bounded number of rows whatever the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import Workspace, small

LIMIT = 2.0
BLOCK_ROWS = 20_000
STEPS = 30


def tokens(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def _evenness(sources: DataFrame, total: float, count: int, exponent: float) -> float:
    """The entropy of the weights at an exponent, over the greatest possible."""
    power = F.pow(F.col("n") / F.lit(total), F.lit(exponent))
    r = sources.agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("e")).first()
    return (math.log(r["z"]) - r["e"] / r["z"]) / math.log(count) if count > 1 else 1.0


def choose_exponent(sources: DataFrame, limit: float | None = LIMIT, entropy: float | None = None, steps: int = STEPS) -> float:
    """Bisect the exponent in 0..1: the least at which no source is repeated more than ``limit`` times as often as
    another, or (with ``entropy``) the greatest whose entropy is at least that share of the greatest possible.

    A source of share p comes p^(x - 1) times, so the limit is decided by the largest and the smallest source alone.
    """
    facts = sources.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    lo, hi = 0.0, 1.0
    if entropy is not None:
        good = lambda x: _evenness(sources, float(facts["n"]), facts["k"], x) >= entropy
        if good(hi):
            return hi
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo
    good = lambda x: (facts["hi"] / facts["lo"]) ** (1 - x) <= limit
    if good(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", limit: float | None = LIMIT,
        entropy: float | None = None, budget: int | None = None, seed: int = 11) -> DataFrame:
    """``docs`` repeated to the weights, with __source_weight, __pass (from 0) and __block.

    Every row without tokens comes out once, outside the budget. Without ``budget`` every row comes out at least once;
    with one, sources whose part is less than a pass give only the first rows of their permutation. Null sources are one
    source. An empty table, or one without tokens, comes back as it is, in pass 0. The result columns replace others of
    their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    own = ["__source_weight", "__pass", "__block"]
    columns = [c for c in docs.columns if c not in own]
    docs = docs.select(*columns)
    rows = docs.withColumn("__tokens", tokens(F.col(text_col)))
    narrow = ws.keep(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "__tokens",
                                 F.xxhash64(F.lit(seed), id_col, text_col).alias("h")))
    sources = ws.keep(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("__tokens").alias("n")).where("n > 0"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs.withColumns({"__source_weight": F.lit(None).cast("double"), "__pass": F.lit(0), "__block": F.lit(0).cast("long")})
    exponent = choose_exponent(sources, limit, entropy)
    power = F.pow(F.col("n") / F.lit(float(total)), F.lit(exponent))
    z = sources.agg(F.sum(power), F.max(F.col("n") / power)).first()
    all_tokens = float(budget) if budget is not None else z[0] * z[1]
    plan = sources.select("source", "rows", "n", (power / z[0]).alias("weight"))
    # The last pass is part of one; a hair's breadth over a whole number of passes is rounding.
    passes = F.col("weight") * F.lit(all_tokens) / F.col("n")
    plan = plan.withColumn("full", F.floor(passes + 1e-9).cast("int")).withColumn(
        "rest", F.greatest((passes - F.col("full")) * F.col("n"), F.lit(0.0)))
    plan = ws.keep(plan.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    spread = rows.withColumn("__h", F.xxhash64(F.lit(seed), id_col, text_col)).join(
        small(plan.select(F.col("source").alias("__s"), "weight", "full", "rest", "blocks")), same(source_col, "__s"), "left")
    # Where the partial pass ends: whole blocks by their sums, then rows inside the block at the edge.
    perm = F.xxhash64("h", F.lit("partial pass"))
    part = narrow.where("__tokens > 0").join(small(plan.where("rest > 0.5").select(F.col("source").alias("__s"), "rest", "blocks")),
                                             same("source", "__s")).withColumn("p", perm)
    part = part.withColumn("block", F.pmod("p", F.col("blocks")))
    sums = part.groupBy("__s", "rest", "block").agg(F.sum("__tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    edge = ws.keep(sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest")
                   .withColumn("whole", F.col("before") + F.col("n") <= F.col("rest")).groupBy("__s")
                   .agg(F.max("block").alias("last"), F.max_by("before", "block").alias("before"), F.max_by("whole", "block").alias("whole")))
    inside = part.join(small(edge.where("not whole").withColumnRenamed("__s", "__e")), same("__s", "__e") & (F.col("block") == F.col("last")))
    upto = F.sum("__tokens").over(Window.partitionBy("__s").orderBy("p", "id").rowsBetween(Window.unboundedPreceding, -1))
    cut = ws.keep(inside.withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0))).where("upto < rest")
                  .groupBy(F.col("__s").alias("__e")).agg(F.max("p").alias("cut")))
    ends = edge.withColumnRenamed("__s", "__e").join(cut.withColumnRenamed("__e", "__c"), F.col("__e").eqNullSafe(F.col("__c")), "left").drop("__c")
    got = spread.join(small(ws.keep(ends)), same("__s", "__e"), "left").withColumn("__p", F.xxhash64("__h", F.lit("partial pass")))
    block = F.pmod("__p", F.col("blocks"))
    more = F.col("rest").isNotNull() & F.col("last").isNotNull() & (
        (block < F.col("last")) | ((block == F.col("last")) & (F.col("whole") | (F.col("__p") <= F.col("cut")))))
    times = F.when(F.col("full").isNull() | (F.col("__tokens") == 0), 1).otherwise(
        F.col("full") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))
    passes = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    out = got.withColumn("__pass", F.explode(passes))
    at = F.pmod(F.when(F.col("__pass") < F.col("full"), F.xxhash64("__h", "__pass")).otherwise(F.col("__p")), F.coalesce("blocks", F.lit(1)))
    return out.select(*columns, F.col("weight").alias("__source_weight"), "__pass", at.cast("long").alias("__block"))
