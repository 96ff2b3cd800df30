"""Dimension, crosswalk, hierarchy and reply joins. No hints: Spark broadcasts a side only when its size allows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.plans.ordered import rank_all


def breakdown(facts: DataFrame, dim: DataFrame, on: str, name: str, measure: str) -> DataFrame:
    """Sum a measure by a dimension's name, largest first in ``rank``; facts without a dimension row stay.

    The measure is summed per key before the join, so the join meets one row per key whatever the skew.
    """
    part = facts.groupBy(on).agg(F.sum(measure).alias("__s"), F.count(F.lit(1)).alias("__n"))
    g = part.join(dim.select(on, name), on, "left").groupBy(name).agg(F.sum("__s").alias("total"), F.sum("__n").alias("rows"))
    return rank_all(g, [F.col("total").desc(), F.col(name)])


def owner_registry(registry: DataFrame, models: DataFrame, owner: str, fragment: str, code: str,
                   model_code: str) -> DataFrame:
    """Registered items whose owner contains a text, with the model row when there is one."""
    hit = registry.where(F.upper(owner).contains(fragment.upper()))
    m = models.withColumnRenamed(model_code, code) if model_code != code else models
    return hit.join(m, code, "left")


def versioned_dimension(facts: DataFrame, dims: Mapping[str, DataFrame], version: str, number: str, kind: Column,
                        carry: Sequence[str]) -> DataFrame:
    """Join facts to the dimension table their kind selects, in the version of their year."""
    every = None
    for name, df in dims.items():
        d = df.select(F.lit(name).alias("__kind"), version, number, *carry)
        every = d if every is None else every.unionByName(d)
    return facts.withColumn("__kind", kind).join(every, ["__kind", version, number], "left").withColumnRenamed(
        "__kind", "kind")


def composite_children(parent: DataFrame, child: DataFrame, on: Sequence[str], fields: Sequence[str],
                       out: str = "uses") -> DataFrame:
    """Child rows joined on a composite key, because one of the ids was damaged by a spreadsheet.

    One parent key holds a handful of uses, so they travel as an array.
    """
    g = child.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    return parent.join(g, list(on), "left")


def wanted_only(bulk: DataFrame, wanted: DataFrame, key: str, guards: Sequence[Column] = ()) -> DataFrame:
    """Bulk rows of the wanted ids (semi join), after the unit and status guards have reached the scan."""
    for g in guards:
        bulk = bulk.where(g)
    return bulk.join(wanted.select(key).distinct(), key, "left_semi")


def older_missing(listed: DataFrame, present: DataFrame, site: str, ident: str) -> DataFrame:
    """Listed ids absent from the facts and older than every id that is present for the site."""
    floor = present.groupBy(site).agg(F.min(ident).alias("__floor"))
    gone = listed.select(site, ident).distinct().join(present.select(site, ident).distinct(), [site, ident], "left_anti")
    return gone.join(floor, site).where(F.col(ident) < F.col("__floor")).drop("__floor")


def unlocated_by_owner(rows: DataFrame, area: Column, located: Column, owner: Column) -> DataFrame:
    """Rows with no location whose owner serves the area, by the folded owner of located rows."""
    d = rows.withColumn("__owner", owner)
    served = d.where(area & (F.col("__owner") != "")).select("__owner").distinct()
    return d.where(~located).join(served, "__owner", "left_semi").drop("__owner")


def program_bridge(df: DataFrame, ident: str, lists: Mapping[str, str]) -> DataFrame:
    """Long bridge (id, program, program id) from list-valued id columns."""
    progs = F.array(*[F.struct(F.lit(p).alias("program"), F.col(c).alias("ids")) for p, c in lists.items()])
    return (df.select(ident, F.explode(progs).alias("p")).select(ident, "p.program", F.explode("p.ids").alias("program_id"))
            .distinct())


def crosswalk(bridge: DataFrame, ident: str, source: str, target: str) -> DataFrame:
    """Program ids of one program to those of another through the shared registry id, both ways readable."""
    a = bridge.where(F.col("program") == source).select(ident, F.col("program_id").alias(source))
    b = bridge.where(F.col("program") == target).select(ident, F.col("program_id").alias(target))
    return a.join(b, ident).select(source, target).distinct()


def rank_by_programs(bridge: DataFrame, ident: str) -> DataFrame:
    return bridge.groupBy(ident).agg(F.countDistinct("program").alias("programs"), F.count(F.lit(1)).alias("ids"))


def reply_links(reports: DataFrame, ident: str, text: str, pattern: str) -> DataFrame:
    """Reports whose text cites an older report number, with whether that report is on file."""
    cited = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")
    r = reports.withColumn("update_of", cited).where(F.col("update_of").isNotNull())
    known = reports.select(F.col(ident).alias("update_of")).distinct().withColumn("__k", F.lit(True))
    return r.join(known, "update_of", "left").withColumn("on_file", F.coalesce("__k", F.lit(False))).drop("__k")


def minutes_for_items(agenda: DataFrame, minutes: DataFrame, meeting: str, number: str, sub: str,
                      fields: Sequence[str], stamp: str, outcome: str) -> DataFrame:
    """Agenda items with the minutes' fields: a sub-item inherits what the whole item says, its own words win.

    ``stamp_conflict`` marks an agenda stamp the minutes contradict; the minutes stand.
    """
    own = minutes.where(F.col(sub).isNotNull()).groupBy(meeting, number, sub).agg(
        *[F.max(F.nullif(F.col(f), F.lit(""))).alias(f"__o_{f}") for f in fields])
    whole = minutes.where(F.col(sub).isNull()).groupBy(meeting, number).agg(
        *[F.max(F.nullif(F.col(f), F.lit(""))).alias(f"__w_{f}") for f in fields])
    j = agenda.join(own, [meeting, number, sub], "left").join(whole, [meeting, number], "left")
    j = j.withColumns({f: F.coalesce(f"__o_{f}", f"__w_{f}") for f in fields})
    first = F.lower(F.element_at(F.split(F.col(stamp), " "), 1))
    conflict = F.coalesce((F.col(outcome) != "") & F.col(stamp).isNotNull() & ~F.col(outcome).contains(first), F.lit(False))
    result = F.coalesce(F.col(outcome), F.lower(stamp), F.lit("not recorded in minutes"))
    return j.withColumns({"stamp_conflict": conflict, "result": result}).drop(
        *[f"__{p}_{f}" for p in "ow" for f in fields])


def served_population(sellers: DataFrame, supply: DataFrame, systems: DataFrame, ident: str, seller: str, buyer: str,
                      population: str) -> tuple[DataFrame, DataFrame]:
    """(per seller: buyers and their population; one row: people over sellers and buyers, each system once)."""
    pop = systems.select(F.col(ident).alias(buyer), F.coalesce(population, F.lit(0)).alias("__p"))
    pairs = supply.select(seller, buyer).distinct().where(F.col(seller) != F.col(buyer)).join(
        sellers.select(F.col(ident).alias(seller)), seller, "left_semi").join(pop, buyer, "left")
    per = pairs.groupBy(seller).agg(F.count(F.lit(1)).alias("buyers"), F.sum("__p").alias("buyer_population"))
    ids = sellers.select(F.col(ident).alias(buyer)).unionByName(pairs.select(buyer)).distinct()
    total = ids.join(pop, buyer, "left").agg(F.count(F.lit(1)).alias("systems"), F.sum("__p").alias("population"))
    return per, total


def select_questions(bank: DataFrame, classes: DataFrame, always: Sequence[str], processes: Sequence[str]) -> DataFrame:
    """Questions that apply: a filled permit type must match a document; a blank one follows its group.

    ``classes`` holds the permit types under review (a short list). An always-included group admits the group, not a
    row of it whose own permit type does not fit.
    """
    types = classes.agg(F.collect_set("permit_type").alias("t")).select("t").scalar()
    own = F.coalesce(F.size("permit_types"), F.lit(0)) > 0
    fits = F.arrays_overlap("permit_types", types)
    group_in = F.col("group").isin(*always) | (F.col("group_kind").eqNullSafe("process") & F.col("group").isin(*processes))
    why = (F.when(own & fits, "permit type").when(~own & F.col("group").isin(*always), "always included")
           .when(~own & group_in, "process"))
    return bank.withColumn("why", why).where(F.col("why").isNotNull())


def impairment_allocations(units: DataFrame, actions: DataFrame, allocations: DataFrame, unit: str, action: str,
                           permit: str, permits: Sequence[str]) -> DataFrame:
    """Units with linked actions and the allocations of the given permits; a miss reads "none under these ids".

    The unit id is normalised, since one water is written two ways inside one record.
    """
    norm = lambda c: F.regexp_replace(F.element_at(F.split(F.upper(c), "_"), 1), "[^A-Z0-9]", "")
    u = units.withColumn("__u", norm(F.col(unit)))
    a = actions.select(norm(F.col(unit)).alias("__u"), action).distinct()
    al = allocations.where(F.col(permit).isin(*permits)).groupBy(action).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("amount").alias("__amt"))
    j = u.join(a, "__u", "left").join(al, action, "left").groupBy(unit).agg(
        F.count(action).alias("actions"), F.sum("__n").alias("allocations"), F.sum("__amt").alias("amount"))
    return j.withColumn("allocations", F.coalesce("allocations", F.lit(0))).withColumn(
        "status", F.when(F.col("actions") == 0, "no linked action").when(F.col("allocations") > 0, "allocated")
        .otherwise("none under these ids"))


def parents(entities: DataFrame, edges: DataFrame, ident: str, child: str, parent: str, exceptions: DataFrame,
            hops: int = 2) -> DataFrame:
    """Direct and ultimate parent by one join per hop, or the reporting exception in their place."""
    step = edges.select(F.col(child).alias("__c"), F.col(parent).alias("__p"))
    d = entities.select(ident).join(step, F.col(ident) == F.col("__c"), "left").select(
        ident, F.col("__p").alias("direct_parent"), F.col("__p").alias("ultimate_parent"))
    for _ in range(hops - 1):
        d = d.join(step, F.col("ultimate_parent") == F.col("__c"), "left").select(
            ident, "direct_parent", F.coalesce("__p", "ultimate_parent").alias("ultimate_parent"))
    d = d.join(exceptions.select(ident, "reason"), ident, "left")
    return d.withColumn("exception_reason", F.when(F.col("direct_parent").isNull(), F.col("reason"))).drop("reason")


def prefer_first(first: DataFrame, second: DataFrame, ident: str) -> DataFrame:
    """Union by id of two incomplete tables: a row of the first table wins, the second only fills in."""
    return first.withColumn("source_rank", F.lit(1)).unionByName(
        second.join(first.select(ident), ident, "left_anti").withColumn("source_rank", F.lit(2)))


def once_each(chunks: Sequence[DataFrame], ident: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overlapping chunks put together with each identity once (the first in ``order``)."""
    u = chunks[0]
    for c in chunks[1:]:
        u = u.unionByName(c)
    other = [c for c in u.columns if c not in ident]
    g = u.groupBy(*ident).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("__b"))
    return g.select(*ident, *[F.col(f"__b.{c}").alias(c) for c in other])


def new_since(current: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key was not seen before, one per key."""
    return current.dropDuplicates(list(key)).join(seen.select(*key).distinct(), list(key), "left_anti")


def open_periods(df: DataFrame, opens: str, closes: str, as_of: str, soon: int = 14) -> DataFrame:
    """Periods open on a day (both ends inclusive) with days left and whether they close soon."""
    day = F.lit(as_of).cast("date")
    d = df.where((F.col(opens) <= day) & (F.col(closes) >= day)).withColumn("days_left", F.datediff(closes, day))
    return d.withColumn("closing_soon", F.col("days_left") <= soon)


def changed_lines(old: DataFrame, new: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Lines added and removed between two versions, counted as multisets."""
    a = old.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("__a"))
    b = new.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("__b"))
    j = a.join(b, [*keys, line], "full_outer").na.fill(0, ["__a", "__b"])
    return j.where(F.col("__a") != F.col("__b")).select(
        *keys, line, F.greatest(F.col("__b") - F.col("__a"), F.lit(0)).alias("added"),
        F.greatest(F.col("__a") - F.col("__b"), F.lit(0)).alias("removed"))


def unified_diff(pairs: DataFrame, key: Sequence[str], old: str, new: str, context: int = 3) -> DataFrame:
    """Ordered unified diff of two whole texts per row, as lines with their position (Arrow batches)."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib
        return pd.Series([list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "old", "new",
                                                    n=context, lineterm="")) for x, y in zip(a, b)])
    return pairs.select(*key, F.posexplode(diff(old, new)).alias("pos", "line"))
