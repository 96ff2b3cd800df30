"""Ordered work over keys that may hold a third of all rows.

A window partitioned by such a key would put that third in one task. These helpers cut the rows of a hot key into
ordered chunks, run the window inside (key, chunk), reduce each chunk to one carry row, run a second window over the
carry rows only, and join the carry back. Results equal the plain window.

The cut is chosen from the data: a key with more than ``ROWS_PER_CHUNK`` rows is split at quantiles of its order column,
so that a chunk holds about that many rows wherever outliers and bursts lie; every other key is one chunk. The cuts are
checkpointed, so a retried task cuts in the same place. Rows of one order value stay in one chunk. ``order`` must be total
within a key and start with a number, date or time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.plans.durable import durable

_CHUNK = "__chunk"
ROWS_PER_CHUNK = 1_000_000
MOST_CHUNKS = 10_000  # of one key: its cuts travel as one array
_STEP = 64  # cuts passed over by one coarse comparison


def _number(c: Column, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return F.unix_micros(c).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def add_chunks(df: DataFrame, keys: Sequence[str], order, out: str = "__ck", rows: int | None = None) -> DataFrame:
    """Add ``out``: 0 for ordinary keys, an ordered chunk number for hot ones.

    The hot keys are counted when this is called; where there are none, no join is planned.
    """
    rows = rows or ROWS_PER_CHUNK
    first = F.col(order) if isinstance(order, str) else order
    kind = df.select(first.alias("__o")).dtypes[0][1]
    d = df.withColumn("__x", _number(first, kind))
    hot = durable(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows))
    most = hot.agg(F.max("__n")).first()[0]
    if most is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    cuts = durable(_cuts(d, hot, keys, rows, min(MOST_CHUNKS, -(-most // rows))))
    if keys:
        d = d.alias("l").join(cuts.alias("r"), _null_safe(keys), "left").select("l.*", "r.__cuts", "r.__coarse")
    else:
        d = d.withColumns({c: cuts.select(c).scalar() for c in ("__cuts", "__coarse")})
    below = lambda cs: F.size(F.filter(cs, lambda c: c < F.col("__x")))
    d = d.withColumn("__at", F.coalesce(below("__coarse"), F.lit(0)) * _STEP)
    fine = below(F.slice("__cuts", F.col("__at") + 1, F.lit(_STEP)))
    chunk = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.col("__at") + fine)
    return d.withColumn(out, chunk.cast("long")).drop("__x", "__cuts", "__coarse", "__at")


def _cuts(d: DataFrame, hot: DataFrame, keys: Sequence[str], rows: int, most: int) -> DataFrame:
    """(keys, __cuts, __coarse): ascending cuts of each hot key, as many as its rows ask for, and every 64th of them."""
    if keys:
        d = d.alias("l").join(hot.alias("r"), _null_safe(keys)).select("l.*", "r.__n")
    else:
        d = d.withColumn("__n", hot.select("__n").scalar())
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    g = d.groupBy(*keys).agg(F.max("__n").alias("__n"), F.percentile_approx("__x", shares, F.lit(max(1000, 10 * most))).alias("__q"))
    step = F.greatest(F.floor(F.lit(most * rows) / F.col("__n")), F.lit(1))
    g = g.withColumn("__step", step).withColumn("__cuts", F.filter("__q", lambda c, i: (i + 1) % F.col("__step") == 0))
    return g.select(*keys, "__cuts", F.filter("__cuts", lambda c, i: i % _STEP == _STEP - 1).alias("__coarse"))


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None) -> DataFrame:
    return add_chunks(df, keys, order[0], _CHUNK) if chunk is None else df.withColumn(_CHUNK, chunk)


def _null_safe(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    on = [*keys, _CHUNK]
    joined = df.alias("l").join(carry.alias("r"), _null_safe(on), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in cols])


def _neighbour(df, keys, order, cols, chunk, out, forward):
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    d = _chunked(df, keys, order, chunk)
    item = F.struct(*cols)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    inside = (F.lead if forward else F.lag)(item).over(w)
    edge = (F.min_by if forward else F.max_by)(item, F.struct(*order)).alias("__edge")
    carry = d.groupBy(*keys, _CHUNK).agg(edge)
    wk = Window.partitionBy(*keys).orderBy(F.col(_CHUNK))
    carry = carry.withColumn("__edge", (F.lead if forward else F.lag)("__edge").over(wk))
    got = _attach(d.withColumn(out, inside), carry, keys, ["__edge"])
    return got.withColumn(out, F.coalesce(out, "__edge")).drop("__edge", _CHUNK)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str],
                  chunk: Column | None = None, out: str = "prev") -> DataFrame:
    """Add struct ``out`` with ``cols`` of the row before (null on a key's first row)."""
    return _neighbour(df, keys, order, cols, chunk, out, False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str],
              chunk: Column | None = None, out: str = "next") -> DataFrame:
    """Add struct ``out`` with ``cols`` of the row after (null on a key's last row)."""
    return _neighbour(df, keys, order, cols, chunk, out, True)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None,
            spec: Mapping[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Running aggregates. ``spec`` maps an output name to (kind, column), kind in sum | max | last | first_next.

    ``last`` carries the last non-null value forward; ``first_next`` the first non-null value at or after
    the row (backward fill). With ``inclusive=False`` the current row is left out.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*order)
    d = _chunked(df, keys, order, chunk)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    wk = Window.partitionBy(*keys).orderBy(F.col(_CHUNK))
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    back, ahead = (0, 0) if inclusive else (-1, 1)
    inside, total, carried = {}, [], {}
    for name, (kind, col) in spec.items():
        c = F.col(col)
        t = f"__t_{name}"
        if kind == "sum":
            inside[name] = F.sum(c).over(w.rowsBetween(low, back))
            total.append(F.sum(c).alias(t))
            carried[t] = F.sum(t).over(wk.rowsBetween(low, -1))
        elif kind == "max":
            inside[name] = F.max(c).over(w.rowsBetween(low, back))
            total.append(F.max(c).alias(t))
            carried[t] = F.max(t).over(wk.rowsBetween(low, -1))
        elif kind == "last":
            inside[name] = F.last(c, ignorenulls=True).over(w.rowsBetween(low, back))
            total.append(F.max_by(c, F.when(c.isNotNull(), key)).alias(t))
            carried[t] = F.last(t, ignorenulls=True).over(wk.rowsBetween(low, -1))
        elif kind == "first_next":
            inside[name] = F.first(c, ignorenulls=True).over(w.rowsBetween(ahead, high))
            total.append(F.min_by(c, F.when(c.isNotNull(), key)).alias(t))
            carried[t] = F.first(t, ignorenulls=True).over(wk.rowsBetween(1, high))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    carry = d.groupBy(*keys, _CHUNK).agg(*total).withColumns(carried)
    got = _attach(d.withColumns(inside), carry, keys, list(carried))
    final = {}
    for name, (kind, _) in spec.items():
        t = F.col(f"__t_{name}")
        v = F.col(name)
        if kind == "sum":
            final[name] = F.when(v.isNull() & t.isNull(), None).otherwise(
                F.coalesce(v, F.lit(0)) + F.coalesce(t, F.lit(0)))
        elif kind == "max":
            final[name] = F.greatest(v, t)
        else:
            final[name] = F.coalesce(v, t)
    return got.withColumns(final).drop(*carried, _CHUNK)


def position(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None = None,
             out: str = "pos") -> DataFrame:
    """1-based row number per key, chunk by chunk."""
    d = df.withColumn("__one", F.lit(1).cast("long"))
    return running(d, keys, order, chunk, {out: ("sum", "__one")}).drop("__one")


def rank_all(df: DataFrame, order: Sequence, out: str = "rank") -> DataFrame:
    """1-based place of every row in one order of the whole table, with no window over all rows.

    A range sort numbers the rows inside its partitions and is checkpointed, so the numbers stand; the window runs over the
    partitions' counts, one row for each partition.
    """
    d = durable(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())).withColumn(
        "__p", F.shiftright("__id", 33))
    counts = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(starts, "__p").withColumn(out, F.col("__start") + inside + 1).drop("__p", "__id", "__start")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, starts: Column, prev_cols: Sequence[str],
            out: str = "island") -> DataFrame:
    """Number runs of rows. ``starts`` is a Column over the row and ``prev`` (struct of ``prev_cols``)."""
    ck = F.col("__ck")
    d = with_previous(add_chunks(df, keys, order[0]), keys, order, prev_cols, ck, "prev")
    d = d.withColumn("__start", F.when(F.col("prev").isNull() | starts, 1).otherwise(0).cast("long"))
    return running(d, keys, order, ck, {out: ("sum", "__start")}).drop("__start", "__ck")
