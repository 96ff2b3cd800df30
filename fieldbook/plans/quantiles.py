"""Exact quantiles for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a fixed-size sketch
brackets each wanted rank, every row is classed below, inside or above the brackets, the classes are counted,
and only the rows of the class that holds the rank are ranked. The sketch decides how many rows are ranked,
never which value comes out, so the answer is exact whatever the sketch's error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], upper: bool = False, accuracy: int = 2000) -> DataFrame:
    """One row per key with a column per probability and ``n`` (non-null values).

    Linear interpolation between neighbours (the usual "linear" rule), or with ``upper`` the element at
    floor(p*n) of the ascending values, which for 0.5 is the upper median.
    """
    keys = list(keys)
    if not keys:
        one = df.withColumn("__all", F.isnotnull(F.col(value)))
        return exact_quantiles(one, ["__all"], value, probs, names, upper, accuracy).drop("__all")
    keyed = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("__v"))
    vals = keyed.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    step = 2.0 / accuracy
    cuts = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-step, step)})
    sketch = keyed.groupBy(*keys).agg(  # of the rows, not of distinct values: repeats weigh in the ranks
        F.percentile_approx("__v", F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("__cuts"))
    # merge joins: a size guessed before the rows are counted may send the larger side whole through the driver
    if keys:
        j = vals.join(sketch.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cuts").hint("merge"),
                      on=_on(vals, keys), how="inner").drop(*[f"__k_{k}" for k in keys])
    else:
        j = vals.withColumn("__cuts", sketch.select("__cuts").scalar())
    d = j.withColumn("__cls", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    wk = Window.partitionBy(*keys).orderBy("__cls")
    cnt = (d.groupBy(*keys, "__cls").agg(F.sum("__c").alias("__n"))
           .withColumn("__before", F.coalesce(F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
           .withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys))))
    last = F.col("__total") - 1
    wanted = []
    for p in probs:
        if upper:
            lo = hi = F.least(F.floor(F.lit(p) * F.col("__total")), last)
        else:
            pos = F.lit(float(p)) * last
            lo, hi = F.floor(pos), F.ceil(pos)
        wanted += [lo.cast("long"), hi.cast("long")]
    cnt = cnt.withColumn("__want", F.array(*wanted))
    hit = F.exists("__want", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    cnt = cnt.where(hit).select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                                F.col("__cls").alias("__k_cls"), "__before", "__total", "__want")
    cond = _on(d, keys, extra=d["__cls"] == F.col("__k_cls"))
    kept = d.join(cnt.hint("merge"), on=cond, how="inner").drop(*[f"__k_{k}" for k in keys], "__k_cls")
    w = Window.partitionBy(*keys, "__cls").orderBy("__v")
    kept = kept.withColumn("__end", F.col("__before") + F.sum("__c").over(
        w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - F.col("__c"))
    picks = []
    for i in range(2 * len(probs)):
        r = F.element_at("__want", i + 1)
        picks.append(F.max(F.when((r >= F.col("__start")) & (r < F.col("__end")), F.col("__v"))).alias(f"__p{i}"))
    agg = kept.groupBy(*keys).agg(F.max("__total").alias("n"), *picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        lo, hi = F.col(f"__p{2 * i}"), F.col(f"__p{2 * i + 1}")
        if upper:
            out.append(lo.alias(name))
        else:
            pos = F.lit(float(p)) * (F.col("n") - 1)
            out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*keys, "n", *out)


def _on(left: DataFrame, keys: Sequence[str], extra=None):
    cond = extra
    for k in keys:
        c = left[k].eqNullSafe(F.col(f"__k_{k}"))
        cond = c if cond is None else cond & c
    return cond if cond is not None else F.lit(True)
