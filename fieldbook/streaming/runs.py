"""Streaming plans over the same operators, and a runner that drains what is available."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fieldbook.plans.skew import MOST_TASKS, PAIRS_PER_TASK
from fieldbook.sources.sinks import exists, scratch
from fieldbook.streaming.processors import Changes, Trigger


def read_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files ``folder/name*.parquet``; zone-less timestamps become UTC timestamps."""
    schema = spark.read.option("pathGlobFilter", f"{name}*.parquet").parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    df = r.parquet(folder)
    for f in schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def drain(stream: DataFrame, mode: str, name: str, sink: str | None = None, checkpoint: str | None = None) -> str:
    """Run to the end of the available input; each batch overwrites its own folder, so a replayed batch adds nothing."""
    spark = stream.sparkSession
    out = sink or scratch(spark, name)
    state = checkpoint or scratch(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key that an update-mode run wrote."""
    d = spark.read.parquet(path)
    other = [c for c in d.columns if c not in keys and c != "batch"]
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*other), "batch").alias("__b"))
    return g.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in other])


def drain_first_seen(events: DataFrame, key: Sequence[str], name: str, sink: str | None = None,
                     checkpoint: str | None = None) -> str:
    """Run to the end of the available input and write one row for each key never seen before, however old or late.

    What the sink holds is the set of seen keys, whichever checkpoint wrote it; a batch meets it by an anti join and
    overwrites its own folder, so a trailing re-scan, a replayed batch and a fresh checkpoint over an old sink add nothing.
    Null keys are keys like others.
    """
    spark = events.sparkSession
    out = sink or scratch(spark, name)
    state = checkpoint or scratch(spark, f"{name}-state")
    run = f"r{hashlib.sha256(state.encode()).hexdigest()[:16]}"

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(list(key))
        if exists(batch.sparkSession, out):
            seen = batch.sparkSession.read.option("basePath", out).schema(_partitioned(batch)).parquet(out)
            seen = seen.where((F.col("run") != run) | (F.col("batch") != batch_id))
            seen = seen.select(*[F.col(c).alias(f"__seen_{c}") for c in key]).distinct()
            met = F.lit(True)
            for c in key:
                met = met & new[c].eqNullSafe(seen[f"__seen_{c}"])
            new = new.join(seen, met, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")
    (events.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", state)
     .trigger(availableNow=True).start()).awaitTermination()
    return out


def _partitioned(batch: DataFrame) -> T.StructType:
    return T.StructType([*batch.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])


def event_lag(readings: DataFrame, events: DataFrame, keys: Sequence[str], reading_ts: str, event_ts: str, most: str,
              reading_delay: str = "1 hour", event_delay: str = "1 hour", how: str = "inner",
              packed: bool = False) -> DataFrame:
    """Readings of the same ``keys`` from an event on until ``most`` later, with ``lag_s`` in seconds.

    Both sides may be streams. Each has a watermark of its own: a row that comes later than its side's delay is not
    matched any more, and state is kept only as long as a partner may still come. Sides meet on the key and on slices of
    ``most``, so that a busy key is spread over time. With ``how="left_outer"`` an event that no reading follows is returned
    with nulls once that is certain, so that nothing measured is told from nothing known yet. Columns of the two sides
    must differ but for ``keys``; rows with a null key or time meet nothing.

    The pairs grow with the square of the rows in a span of time. With ``packed`` (inner only) the rows of a key and slice
    travel as lists, and the result has lists that hold pairs; ``lag_pairs`` takes the pairs out of what was drained. A
    list is late when its newest row is, so a late row may still be matched that comes in one batch and slice with others.
    """
    if packed:
        if how != "inner":
            raise ValueError("only an inner event_lag can be packed")
        return _packed_lag(readings, events, keys, reading_ts, event_ts, most, reading_delay, event_delay)
    width, micros = F.expr(f"interval {most}"), _seconds(most) * 1_000_000
    at = lambda c: F.floor(F.unix_micros(c) / micros)
    r, e = readings.withWatermark(reading_ts, reading_delay), events.withWatermark(event_ts, event_delay)
    if how == "inner":
        r, e = r.withColumn("__slice", at(reading_ts)), e.withColumn("__slice", F.explode(F.array(at(event_ts), at(event_ts) + 1)))
    else:  # an event is one row of the result if nothing follows it, so it can't be in two slices
        r, e = r.withColumn("__slice", F.lit(0)), e.withColumn("__slice", F.lit(0))
    shared = [*keys, "__slice"]
    on = (F.col(reading_ts) >= F.col(event_ts)) & (F.col(reading_ts) <= F.col(event_ts) + width)
    for c in shared:
        r = r.withColumnRenamed(c, f"__r_{c}")
        on = on & (F.col(c) == F.col(f"__r_{c}"))
    lag = (F.unix_micros(reading_ts) - F.unix_micros(event_ts)) / 1_000_000
    return e.join(r, on, how).drop("__slice", *[f"__r_{c}" for c in shared]).withColumn("lag_s", lag)


LIST_ROWS = 5_000  # of a list, so that two lists hold 25 million pairs at most
HELD_ROWS = 200_000  # that a task gathers before it makes lists of them


def _packed_lag(readings: DataFrame, events: DataFrame, keys: Sequence[str], reading_ts: str, event_ts: str, most: str,
                reading_delay: str, event_delay: str) -> DataFrame:
    """``keys`` and the lists __events and __readings, wherever the times of two lists allow a pair."""
    width = F.expr(f"interval {most}")
    r = _lists(readings, keys, reading_ts, most, "__readings", "__r").withWatermark("__r_hi", reading_delay)
    e = _lists(events, keys, event_ts, most, "__events", "__e").withWatermark("__e_hi", event_delay)
    e = e.withColumn("__slice", F.explode(F.array(F.col("__slice"), F.col("__slice") + 1)))
    on = (F.col("__r_hi") >= F.col("__e_lo")) & (F.col("__r_lo") <= F.col("__e_hi") + width)
    # a list lies within a slice, so these follow; they bound the two watermark columns, by which state is dropped
    on = on & (F.col("__r_hi") + width >= F.col("__e_hi")) & (F.col("__r_hi") <= F.col("__e_hi") + width + width)
    for c in [*keys, "__slice"]:
        r = r.withColumnRenamed(c, f"__r_{c}")
        on = on & (F.col(c) == F.col(f"__r_{c}"))
    return e.join(r, on).select(*keys, "__events", "__readings")


def _lists(rows: DataFrame, keys: Sequence[str], ts: str, most: str, name: str, span: str) -> DataFrame:
    """Lists of the rows of one key and slice, up to ``LIST_ROWS`` each, with their least and greatest time."""
    by = [*keys, "__slice"]
    body = F.struct(*[c for c in rows.columns if c not in keys]).alias(name)
    at = F.floor(F.unix_micros(ts) / (_seconds(most) * 1_000_000)).alias("__slice")
    rows = rows.where(F.col(ts).isNotNull()).select(*keys, at, body).repartition(*by)

    def lists(held):
        t = pa.Table.from_batches(held)
        at = t.select(by).append_column("__row", pa.array(np.arange(len(t)))).group_by(by, use_threads=False).aggregate(
            [("__row", "list")])
        row = pa.concat_arrays(at["__row_list"].chunks)
        n = row.value_lengths().to_numpy()
        cuts = -(-n // LIST_ROWS)
        group = np.repeat(np.arange(len(n)), cuts)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.append(np.repeat(np.cumsum(n) - n, cuts) + nth * LIST_ROWS, len(t))
        body = pa.concat_arrays(t[name].chunks).take(row.flatten())
        made = [pa.concat_arrays(at[c].chunks).take(pa.array(group)) for c in by]
        return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(start, pa.int32()), body)], names=[*by, name])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD_ROWS:
                yield lists(held)
                held, n = [], 0
        if n:
            yield lists(held)

    fields = rows.schema.fields
    out = T.StructType([*fields[:-1], T.StructField(name, T.ArrayType(fields[-1].dataType))])
    times = F.col(f"{name}.{ts}")
    return rows.mapInArrow(run, out).withColumns({f"{span}_lo": F.array_min(times), f"{span}_hi": F.array_max(times)})


def lag_pairs(packed: DataFrame, reading_ts: str, event_ts: str, most: str) -> DataFrame:
    """The pairs that a drained, packed ``event_lag`` holds, with its columns; made where they are used, never stored.

    The lists are dealt over as many tasks as their pairs ask for.
    """
    held = packed.agg(F.sum(F.size("__events").cast("double") * F.size("__readings"))).first()[0] or 0.0
    tasks = min(MOST_TASKS, math.ceil(held / PAIRS_PER_TASK))
    rows = packed.repartition(tasks) if tasks > 1 else packed
    rows = rows.withColumn("__events", F.explode("__events")).withColumn("__readings", F.explode("__readings"))
    r, e = F.col(f"__readings.{reading_ts}"), F.col(f"__events.{event_ts}")
    rows = rows.where((r >= e) & (r <= e + F.expr(f"interval {most}")))
    keys = [c for c in packed.columns if c not in ("__events", "__readings")]
    return rows.select(*keys, "__events.*", "__readings.*", ((F.unix_micros(r) - F.unix_micros(e)) / 1_000_000).alias("lag_s"))


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def tumbling(events: DataFrame, ts: str, keys: Sequence[str], width: str, aggs: Sequence, delay: str = "10 days",
             slide: str | None = None) -> DataFrame:
    """Aggregates per time window; ``slide`` makes the windows overlap."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = events.withWatermark(ts, delay).groupBy(win.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), *[c for c in g.columns if c != "w"])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(events: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """Apply a processor. Its kind of state needs the store on disk, which is set for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy(key).transformWithStateInPandas(processor, out, "append", "none")


def state_changes(events: DataFrame, key: str, ts: str, ident: str, on: str, piece: str = "1 hour") -> DataFrame:
    """START-UP and SHUTDOWN events of an unbounded feed: one on/off flag and the last time are kept per unit.

    Rows of one batch are put in time order, by slices of ``piece``; a row older than the unit's last seen time is reported
    as LATE, never silently used. ``ident`` is a whole number. Rows without a time or a flag are left out.
    """
    known = events.where(F.col(ts).isNotNull() & F.col(on).isNotNull() & F.col(ident).isNotNull()).select(
        key, ts, F.col(ident).cast("long").alias(ident), F.col(on).cast("double").alias(on))
    step = Changes(key, ts, ident, on, _seconds(piece) * 1_000_000)
    return _stateful(known, key, step, f"{key} {dict(events.dtypes)[key]}, {ident} long, event string")


def trigger_events(events: DataFrame, key: str, ts: str, ident: str, value: str, short: int, long: int, on: float,
                   off: float, piece: str = "1 hour") -> DataFrame:
    """Trigger on/off marks of the short over long average. The state is the last ``long`` values and the on flag.

    Rows of one batch are put in time order, by slices of ``piece``. Rows without a time or a value are left out.
    """
    known = events.where(F.col(ts).isNotNull() & F.col(value).isNotNull() & F.col(ident).isNotNull()).select(
        key, ts, F.col(ident).cast("long").alias(ident), F.col(value).cast("double").alias(value))
    step = Trigger(key, ts, ident, value, _seconds(piece) * 1_000_000, short, long, on, off)
    return _stateful(known, key, step, f"{key} {dict(events.dtypes)[key]}, {ident} long, mark string")
