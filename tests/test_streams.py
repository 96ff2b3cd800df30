"""Streams over several files and batches give the batch answer; restarts add nothing; late rows are named."""

import tempfile

from pyspark.sql import functions as F

from fieldbook.sources import table
from fieldbook.streaming import runs


def _files(spark, sf, parts=4):
    folder = tempfile.mkdtemp(prefix="fieldbook-stream-")
    e = table(spark, sf, "events")
    for i in range(parts):
        day = F.dayofmonth("ts")
        e.where((day > i * 8) & (day <= (i + 1) * 8)).coalesce(1).write.parquet(f"{folder}/tmp{i}")
    import glob
    import os
    import shutil
    for i in range(parts):
        src = glob.glob(f"{folder}/tmp{i}/*.parquet")[0]
        shutil.copy(src, f"{folder}/events-{i}.parquet")
        os.utime(f"{folder}/events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return folder, e


def test_state_changes_over_batches(spark, sf):
    folder, e = _files(spark, sf)
    flag = (F.get_json_object("props", "$.k").cast("int") % 3 != 0).alias("on")
    s = runs.read_stream(spark, folder, "events-", 1).select("user_id", "ts", "event_id", flag)
    got = spark.read.parquet(runs.drain(runs.state_changes(s, "user_id", "ts", "event_id", "on"), "append", "t"))
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = e.select("user_id", "event_id", "ts", flag).withColumn("p", F.lag("on").over(w)).where("p is not null and p <> on")
    assert {(r["user_id"], r["event_id"]) for r in got.collect()} == {(r["user_id"], r["event_id"]) for r in want.collect()}


def test_windows_over_batches_and_restart(spark, sf):
    folder, e = _files(spark, sf)
    from fieldbook.sources.sinks import scratch
    sink, state = scratch(spark, "w"), scratch(spark, "ws")

    def go():
        s = runs.tumbling(runs.read_stream(spark, folder, "events-", 1), "ts", ["event_type"], "1 hour", [
            F.count(F.lit(1)).alias("n")], delay="40 days")
        runs.drain(s, "update", "w", sink, state)
        return {(r["start"], r["event_type"], r["n"]) for r in runs.latest_rows(spark, sink, ["start", "event_type"]).collect()}
    want = {(r["start"], r["event_type"], r["n"]) for r in e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert go() == want
    assert go() == want  # a second run finds nothing new


def test_first_seen_over_batches(spark, sf):
    folder, e = _files(spark, sf)
    s = runs.read_stream(spark, folder, "events-", 1).select("user_id", "event_type")
    got = spark.read.parquet(runs.drain_first_seen(s, ["user_id", "event_type"], "m"))
    assert got.count() == e.select("user_id", "event_type").distinct().count()


def test_a_key_60_days_apart_is_announced_once(spark):
    import os
    folder = tempfile.mkdtemp(prefix="fieldbook-stream-")
    days = [("a", "2024-01-01"), (None, "2024-01-20"), ("b", "2024-02-10"), ("a", "2024-03-01"), (None, "2024-03-20")]
    for i, row in enumerate(days):
        d = spark.createDataFrame([row, ("c", row[1])], "k string, day string")
        d.toPandas().to_parquet(f"{folder}/seen-{i}.parquet")
        os.utime(f"{folder}/seen-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = runs.read_stream(spark, folder, "seen-", 1).select("k", "day")
    got = spark.read.parquet(runs.drain_first_seen(s, ["k"], "seen")).select("k", "day").collect()
    assert {(r["k"], r["day"]) for r in got} == {("a", days[0][1]), ("c", days[0][1]), (None, days[1][1]), ("b", days[2][1])}
    assert len(got) == 4


def _streamed(spark, rows, schema, name, batches):
    """One file for each list of rows, read one a batch."""
    import os
    folder = tempfile.mkdtemp(prefix="fieldbook-stream-")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).toPandas().to_parquet(f"{folder}/{name}-{i}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{name}-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    assert len(rows) == batches
    return runs.read_stream(spark, folder, f"{name}-", 1)


def test_event_lag_over_five_batches_with_late_rows(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    events = [[("a", 1, at(0)), ("b", 2, at(30))], [("a", 3, at(200))], [("a", 4, at(400)), (None, 5, at(400))],
              [("b", 6, at(10))], [("a", 7, at(1000))]]  # event 6 is later than the watermark
    readings = [[("a", 10, at(0)), ("a", 11, at(90)), ("a", 12, at(91))], [("b", 13, at(31)), ("a", 14, at(210))],
                [("a", 15, at(455)), (None, 16, at(401))], [("b", 17, at(20)), ("a", 18, at(430))], [("a", 19, at(1090)), ("b", 20, at(1001))]]
    want = {(1, 10, 0.0), (1, 11, 5400.0), (2, 13, 60.0), (3, 14, 600.0), (4, 15, 3300.0), (4, 18, 1800.0), (7, 19, 5400.0)}
    for how, more in (("inner", set()), ("left_outer", set())):
        e = _streamed(spark, events, "site string, event_id long, ts timestamp", "e", 5)
        r = _streamed(spark, readings, "site string, reading_id long, read_at timestamp", "r", 5)
        j = runs.event_lag(r, e, ["site"], "read_at", "ts", "90 minutes", "30 minutes", "30 minutes", how)
        got = [(x["event_id"], x["reading_id"], x["lag_s"]) for x in spark.read.parquet(runs.drain(j, "append", "lag")).collect()]
        assert len(got) == len(set(got))
        found = {g for g in got if g[1] is not None}
        assert found == want | more
    assert {g[0] for g in got if g[1] is None} <= {5, 6}


def test_packed_event_lag_gives_the_pairs_of_the_plain_one(spark, monkeypatch):
    import datetime as dt
    import random

    import pytest
    rnd = random.Random(8)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    site = lambda: rnd.choice(["a", "a", "a", "b", None])
    events = [[(site(), i * 100 + j, at(i * 200 + rnd.randrange(260)) if j else None) for j in range(60)] for i in range(5)]
    readings = [[(site(), i * 100 + j, at(i * 200 + rnd.randrange(260)) if j else None, None if j % 7 == 0 else j / 8) for j in range(60)]
                for i in range(5)]
    events[4] += [("a", 900, at(10)), ("b", 901, at(1090)), ("b", 901, at(1090))]  # one long after its watermark, one twice
    readings[4] += [("b", 902, at(1090), 1.0), ("b", 903, at(1180), 2.0), ("b", 904, at(1181), 3.0), ("a", 905, at(20), 4.0)]
    monkeypatch.setattr(runs, "LIST_ROWS", 7)
    monkeypatch.setattr(runs, "HELD_ROWS", 20)

    def sides():
        return (_streamed(spark, readings, "site string, reading_id long, read_at timestamp, value double", "r", 5),
                _streamed(spark, events, "site string, event_id long, ts timestamp", "e", 5))
    args = (["site"], "read_at", "ts", "90 minutes", "100 minutes", "100 minutes")
    plain = spark.read.parquet(runs.drain(runs.event_lag(*sides(), *args), "append", "lag")).drop("batch")
    lists = spark.read.parquet(runs.drain(runs.event_lag(*sides(), *args, packed=True), "append", "lag")).drop("batch")
    pairs = runs.lag_pairs(lists, "read_at", "ts", "90 minutes")
    assert pairs.columns == plain.columns and pairs.dtypes == plain.dtypes
    want = sorted(map(tuple, plain.collect()), key=str)
    assert sorted(map(tuple, pairs.collect()), key=str) == want and len(want) > 500
    assert lists.where(F.size("__events") > 7).isEmpty() and lists.where(F.size("__readings") > 7).isEmpty()
    with pytest.raises(ValueError):
        runs.event_lag(*sides(), *args, how="left_outer", packed=True)


def test_lag_query_stores_no_pairs(spark, sf, monkeypatch):
    from urllib.parse import urlparse

    import duckdb
    import pyarrow.parquet as pq

    from fieldbook.catalog import load_all
    queries, oracles = load_all()
    drained = []
    drain = runs.drain
    monkeypatch.setattr(runs, "drain", lambda *a, **k: drained.append(drain(*a, **k)) or drained[-1])
    con, stored, pairs = duckdb.connect(), [], []
    for copies in (8, 32):
        folder = tempfile.mkdtemp(prefix="fieldbook-lag-")
        con.execute(f"""copy (select event_id + 1000000 * k as event_id, ts + to_microseconds(k * 7919 + event_id % 1009) as ts,
            user_id + 5000 * k as user_id, event_type, value + k as value, props
            from '{sf}/events.parquet', range({copies}) t(k)) to '{folder}/events.parquet' (format parquet)""")
        con.execute(f"create or replace view events as select * from '{folder}/events.parquet'")
        got = queries["x3_event_lag_stream"](spark, folder)
        key = F.sum(F.col("event_id") * 31 + F.col("reading_id")), F.sum(F.round(F.col("lag_s") * 1_000_000).cast("long"))
        n, ids, lag = got.agg(F.count(F.lit(1)), *key).first()
        assert (n, ids, lag) == con.execute(f"""select count(*), sum(event_id * 31 + reading_id)::bigint, sum(round(lag_s * 1e6)::bigint)::bigint
            from ({oracles["x3_event_lag_stream"]})""").fetchone()
        pairs.append(n)
        files = [pq.ParquetFile(urlparse(f).path).metadata for f in spark.read.parquet(drained[-1]).inputFiles()]
        groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
        stored.append(sum(g.column(c).num_values for g in groups for c in range(g.num_columns)))
    assert pairs[1] > 12 * pairs[0]
    assert stored[1] < 5 * stored[0]


def test_units_in_bounded_pieces_give_the_batch_answer(spark):
    import datetime as dt
    import random

    from fieldbook.operators import series, temporal
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 9), t0 + dt.timedelta(seconds=rnd.randrange(90_000)), i, rnd.random() < 0.5,
             rnd.random() * (5 if i % 97 < 4 else 1)) for i in range(6000)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[i * 1500:(i + 1) * 1500] for i in range(4)]
    for p in parts:
        rnd.shuffle(p)
    parts[2].append((0, t0, 9001, True, 1.0))
    schema = "unit long, ts timestamp, id long, on boolean, value double"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        s = runs.state_changes(_streamed(spark, parts, schema, "u", 4), "unit", "ts", "id", "on")
        got = {(r["unit"], r["id"], r["event"]) for r in spark.read.parquet(runs.drain(s, "append", "u")).collect()}
        parts[2].pop()
        s = runs.trigger_events(_streamed(spark, parts, schema, "v", 4), "unit", "ts", "id", "value", 3, 12, 1.6, 0.9)
        marks = [(r["unit"], r["id"], r["mark"]) for r in spark.read.parquet(runs.drain(s, "append", "v")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, on = {(0, 9001, "LATE")}, {}
    for u, _, i, flag, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if u in on and on[u] != flag:
            want.add((u, i, "START-UP" if flag else "SHUTDOWN"))
        on[u] = flag
    assert got == want
    d = spark.createDataFrame(rows, schema)
    r = series.trigger_ratio(d, ["unit"], ["ts", "id"], "value", 3, 12)
    sessions = temporal.trigger_sessions(r, ["unit"], "pos", "ratio", 1.6, 0.9).collect()
    assert sorted((u, m) for u, _, m in marks if m == "on") == sorted((x["unit"], "on") for x in sessions)
    assert len(sessions) > 20


def test_a_fresh_checkpoint_over_an_old_sink_announces_nothing_again(spark):
    from fieldbook.sources.sinks import scratch
    rows = [[("a", 1)], [("b", 2), ("a", 3)]]
    sink = scratch(spark, "old")
    for checkpoint in (scratch(spark, "c1"), scratch(spark, "c2")):
        s = _streamed(spark, rows, "k string, n long", "k", 2)
        runs.drain_first_seen(s, ["k"], "k", sink, checkpoint)
        got = spark.read.parquet(sink).select("k", "n").collect()
        assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 2)]
