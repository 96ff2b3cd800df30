"""Latest, top, peer rank, jumps, scope widening, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.plans.durable import durable
from fieldbook.plans.ordered import position
from fieldbook.plans.quantiles import exact_quantiles
from fieldbook.plans.skew import salted_join


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, by a max over structs (combined map-side), not by sorting a key's rows."""
    other = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("__b"))
    return g.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in other])


def newest_submission(reports: DataFrame, keys: Sequence[str], submitted: Sequence[str]) -> DataFrame:
    """Of same-day reports keep those of the newest submission; several within one submission all stay."""
    best = reports.groupBy(*keys).agg(F.max(F.struct(*submitted)).alias("__s"))
    return reports.join(best, list(keys)).where(F.struct(*submitted) == F.col("__s")).drop("__s")


def cohort_rank(df: DataFrame, cohort: Sequence[str], ident: str, value: str, top: int) -> tuple[DataFrame, DataFrame]:
    """(top list with ranks, cohort summary): reporters, non-reporters and the upper median (not the averaged one)."""
    w = Window.partitionBy(*cohort).orderBy(F.col(value).desc(), ident)
    ranked = df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    size = df.groupBy(*cohort).agg(F.count(value).alias("reporting"), F.count_if(F.col(value).isNull())
                                   .alias("not_reporting"))
    med = exact_quantiles(df, cohort, value, [0.5], ["median"], upper=True).drop("n")
    return ranked, size.join(med, list(cohort), "left")


def rank_of(df: DataFrame, cohort: Sequence[str], value: str, target: DataFrame) -> DataFrame:
    """Rank of each target row in its cohort: one more than the rows above it, counted, not sorted."""
    t = target.select(*cohort, F.col(value).alias("__t"))
    return (df.join(t, list(cohort)).groupBy(*cohort).agg(
        (F.count_if(F.col(value) > F.col("__t")) + 1).alias("rank"), F.count(value).alias("of")))


def jumps(df: DataFrame, keys: Sequence[str], year: str, value: str, floor: float = 1000.0,
          factor: float = 3.0) -> DataFrame:
    """Latest-year values at or above ``floor`` and ``factor`` times the prior year, where a gap counts as zero.

    The prior year is met by a join on year - 1, not by the row before.
    """
    y = df.groupBy(*keys, year).agg(F.sum(value).alias("latest"))
    last = y.agg(F.max(year).alias("m")).select("m").scalar()
    now = y.where(F.col(year) == last)
    prior = y.select(*keys, (F.col(year) + 1).alias(year), F.col("latest").alias("prior"))
    j = now.join(prior, [*keys, year], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    return j.where((F.col("latest") >= floor) & (F.col("latest") >= F.greatest(F.lit(1.0), F.col("prior")) * factor))


def top_of_latest(df: DataFrame, group: Sequence[str], item: str, year: str, value: str, k: int) -> DataFrame:
    """Top ``k`` items of each group's latest year, with the whole-period total."""
    g = df.groupBy(*group, item, year).agg(F.sum(value).alias("__v"))
    last = g.groupBy(*group).agg(F.max(year).alias("__last"))
    p = g.join(last, list(group)).groupBy(*group, item).agg(
        F.sum(F.when(F.col(year) == F.col("__last"), F.col("__v"))).alias("latest"), F.sum("__v").alias("period"))
    w = Window.partitionBy(*group).orderBy(F.col("latest").desc(), item)
    return p.where(F.col("latest") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sibling_outliers(df: DataFrame, group: Sequence[str], value: str, high: float = 10.0, low: float = 0.1,
                     at_least: int = 3) -> DataFrame:
    """Values more than ``high`` times or less than ``low`` times their siblings' median, in groups big enough."""
    pos = durable(df.where(F.col(value) > 0))  # read five times below
    med = exact_quantiles(pos, group, value, [0.5], ["sibling_median"]).withColumnRenamed("n", "siblings").where(
        (F.col("siblings") >= at_least) & (F.col("sibling_median") > 0))
    j = pos.join(med.hint("merge"), list(group))  # a guessed size must not send the rows through the driver
    return j.where((F.col(value) > F.col("sibling_median") * high) | (F.col(value) < F.col("sibling_median") * low))


def odd_lengths(df: DataFrame, kind: str, value: str, at_least: int = 3) -> DataFrame:
    """Identifiers whose digit count differs from the majority of their kind (ties: the smallest length)."""
    d = df.withColumn("digits", F.length(F.regexp_replace(value, r"\D", "")))
    n = d.groupBy(kind, "digits").agg(F.count(F.lit(1)).alias("__n"))
    maj = n.groupBy(kind).agg(F.min_by("digits", F.struct(-F.col("__n"), "digits")).alias("majority"),
                              F.sum("__n").alias("seen")).where(F.col("seen") >= at_least)
    return d.join(maj, kind).where(F.col("digits") != F.col("majority"))


def nearest_in_scope(df: DataFrame, key: str, size: str, scopes: Mapping[str, str], minimum: int, top: int) -> DataFrame:
    """(target, peer, chosen_scope, place, size_known): of every row with a size its ``top`` peers nearest in size, from the
    first scope that holds ``minimum`` others with a size (the last scope if none does).

    ``scopes`` names columns from narrow to wide; a wider one includes the narrower. Nearness is the size ratio, ties go to
    the smaller key. A size that is null or not positive is unknown: such rows are no targets, and fill a list that has
    too few, flagged, by key. A null scope value is no scope.

    Nothing is compared pairwise: within a scope value the distinct sizes are numbered in order, and a target meets the sizes
    that stand up to ``top`` places from its own, each with its first ``top`` + 1 keys.
    """
    names = list(scopes)
    at, last = ["__s", "__g"], len(names) - 1
    base = df.select(F.col(key).alias("__id"), F.when(F.col(size) > 0, F.col(size).cast("double")).alias("__size"),
                     F.posexplode(F.array(*[F.col(c).cast("string") for c in scopes.values()])).alias(*at)).where("__g is not null")
    known, unknown = base.where("__size is not null"), base.where("__size is null")
    counts = known.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    enough = F.when(F.col("__n") > minimum, F.col("__s"))
    pick = known.join(counts, at).groupBy("__id").agg(F.coalesce(F.min(enough), F.lit(last)).alias("__s"))
    targets = durable(known.join(pick, ["__id", "__s"]))
    first = F.row_number().over(Window.partitionBy(*at, "__size").orderBy("__id"))
    sizes = known.withColumn("__r", first).where(F.col("__r") <= top + 1).groupBy(*at, "__size").agg(F.sort_array(F.collect_list("__id")).alias("__ids"))
    placed = durable(position(sizes, at, ["__size"], out="__p"))
    asked = durable(salted_join(targets, placed.select(*at, "__size", "__p"), [*at, "__size"], ["__id"]).select(
        "__id", *at, F.col("__size").alias("__own"), F.explode(F.sequence(F.col("__p") - top, F.col("__p") + top)).alias("__p")))
    met = salted_join(asked, placed, [*at, "__p"], ["__id"]).withColumn("peer", F.explode("__ids")).where(F.col("peer") != F.col("__id"))
    off = F.abs(F.log(F.col("__size") / F.col("__own")))
    place = F.row_number().over(Window.partitionBy("__id").orderBy(off, "peer"))
    near = durable(met.withColumn("place", place).where(F.col("place") <= top).select(
        "__id", "__s", "peer", "place", F.lit(True).alias("size_known")))
    have = near.groupBy("__id").agg(F.count(F.lit(1)).alias("__have"))
    short = targets.join(have, "__id", "left").select("__id", *at, F.coalesce("__have", F.lit(0)).alias("__have")).where(F.col("__have") < top)
    spare = unknown.withColumn("__u", F.row_number().over(Window.partitionBy(*at).orderBy("__id"))).where(F.col("__u") <= top)
    fill = salted_join(short, spare.select(*at, F.col("__id").alias("peer"), "__u"), at, ["__id"]).where(F.col("__u") <= top - F.col("__have"))
    fill = fill.select("__id", "__s", "peer", (F.col("__have") + F.col("__u")).alias("place"), F.lit(False).alias("size_known"))
    chosen = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("__s") + 1)
    return near.unionByName(fill).select(F.col("__id").alias("target"), "peer", chosen.alias("chosen_scope"),
                                         F.col("place").cast("long").alias("place"), "size_known")


def at_most_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The strongest ``k`` rows per key (a window group limit, so the shuffle carries k rows per task and key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def spread_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows spread evenly over each key's order (all rows when there are no more than ``n``)."""
    d = position(df, keys, order, None, "__pos")
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(total, list(keys)) if keys else d.withColumn("__n", total.select("__n").scalar())
    i = F.col("__pos") - 1
    # row i is taken when some j < n has floor(j * N / n) = i
    j = F.ceil(i * n / F.col("__n"))
    taken = (F.col("__n") <= n) | ((j < n) & (F.floor(j * F.col("__n") / n) == i))
    return d.where(taken).drop("__pos", "__n")


def spread_days(start: Column, end: Column, n: int) -> Column:
    """``n`` dates spread evenly over [start, end] as an array (all of them when the span is short)."""
    span = F.datediff(end, start)
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(
        start, F.bround(i * span / F.lit(max(n - 1, 1)), 0).cast("int")))
    return F.when(span + 1 <= n, F.sequence(start, end)).otherwise(F.array_distinct(steps))
