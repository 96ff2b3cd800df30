"""Balanced label propagation: documents move to the shards of the documents they are linked with, under quotas.

A link is a key that documents share (an equal text, a site, a component); a document may have several. All documents
start in a shard by hash. In each round every link counts its documents by shard, and a document sums the counts of its
links: the shard with the highest sum is where it asks to go. Ties go by a hash of link, shard and round, so that two
halves agree on one place. Requests of two shards to each other are granted as exchanges, which need no room; beyond those,
requests share the room that a shard has left. Every other round only shards with room are asked for, also from
a full shard if the link fits elsewhere, so that a link that its first shard can't hold gathers in a second one. Rounds end when two of them in a row have brought no gain; the best
state counts.

In the rounds a shard may hold a little more than its quota. What is over leaves at the end in whole groups, which go into
the widest gaps; documents that have no partner fill the rest. The result is exact: shard counts differ by one at most. DataFrame functions only; the driver sees one number for each pair of shards. A link
that holds a third of all rows is spread over blocks by its count, and is a few rows of counts for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import Workspace
from fieldbook.plans.skew import salted_join

SHARDS = 16
SLACK = 0.03  # share of a quota that a shard may hold beyond it while documents move
LEAST_GAIN = 0.0005  # of the linked documents: what a round must bring to count as a gain
ROWS_PER_CHUNK = 50_000
ROWS_PER_BLOCK = 100_000


def _quota(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _pick(values: list, at, kind: str = "long"):
    """The member of a short list of numbers."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at + 1)


def granted(flows: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], float]:
    """The share of each (from, to) request count that is granted: exchanges in full, the rest by the room left."""
    swapped = {(i, j): min(n, flows.get((j, i), 0)) for (i, j), n in flows.items()}
    rest = [sum(n - swapped[i, j] for (i, j), n in flows.items() if j == to) for to in range(len(free))]
    return {(i, j): (swapped[i, j] + (n - swapped[i, j]) * min(1.0, max(free[j], 0) / max(rest[j], 1))) / n
            for (i, j), n in flows.items()}


def propagate(ws: Workspace, edges: DataFrame, capacity: list[int]) -> DataFrame:
    """(node, link, blocks, one, shard) after the rounds, from ``edges`` of the same columns, one row for each link of a
    node. ``one`` is 1 on one row of each node and 0 on others; ``blocks`` is the number of blocks of the link."""
    shards, best, gain, idle, turn = len(capacity), edges, None, 0, 0
    linked = edges.count()
    while linked:
        votes = edges.groupBy("link", "shard", "blocks").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("m"))
        tally = ws.keep(votes.groupBy("link", "blocks").agg(F.collect_list(F.struct("shard", "n", "m")).alias("at")))
        size = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        mates = F.aggregate("at", F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["n"]) / size
        inside = [F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == j, x["m"]).otherwise(F.lit(0).cast("long")))
                  for j in range(shards)]
        now, *held = tally.agg(F.sum(mates), *[F.sum(c) for c in inside]).first()
        if gain is None or now >= gain + LEAST_GAIN * linked:
            best, gain, idle = edges, now, 0
        else:
            idle += 1
        if idle == 2 or now >= linked:
            return edges if now > gain else best
        free = [capacity[j] - held[j] for j in range(shards)]
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        mine = edges.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        seen = mine.join(tally.select("link", "at", size.alias("size"), block), ["link", "block"]).select(
            "node", F.col("shard").alias("frm"), "link", "size", F.explode("at").alias("v"))
        seen = seen.select("node", "frm", "size", F.col("v.shard").alias("to"), F.col("v.n").alias("n"),
                           F.xxhash64("link", "v.shard", F.lit(turn)).alias("h"))
        if turn % 2:
            seen = seen.where((_pick(free, F.col("to")) > 0) | ((F.col("to") == F.col("frm")) & (F.col("size") > max(free))))
        score = seen.repartition("node").groupBy("node", "frm", "to").agg(F.sum("n").alias("n"), F.max("h").alias("h"))
        wish = score.groupBy("node", "frm").agg(F.max(F.struct("n", "h", "to")).alias("w"))
        asked = ws.keep(wish.select("node", "frm", F.col("w.to").alias("to")).where("frm <> to"))
        flows = {(r["frm"], r["to"]): r["count"] for r in asked.groupBy("frm", "to").count().collect()}
        share = granted(flows, free)
        table = [share.get((i, j), 0.0) for i in range(shards) for j in range(shards)]
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moves = asked.where(draw < _pick(table, F.col("frm") * shards + F.col("to"), "double")).select("node", "to")
        edges = ws.keep(edges.join(moves, "node", "left").select(
            "node", "link", "blocks", "one", F.coalesce("to", "shard").alias("shard")))
        turn += 1
    return edges


def ranked(ws: Workspace, rows: DataFrame, by: str, order: str, out: str) -> DataFrame:
    """Add ``out``, the place from 0 of each row within ``by``, in the order of a hash of ``order``; ties among equal
    values fall anyhow. Chunks hold a bounded number of rows if values of ``order`` do."""
    count = rows.count()
    parts = max(1, -(-count // ROWS_PER_CHUNK))
    rows = rows.withColumn("__h", F.xxhash64(order)).withColumn("__c", F.pmod("__h", F.lit(parts)).cast("int"))
    size = rows.groupBy(by, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select(by, "__c", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__c").orderBy("__h", order)) - 1
    return (rows.withColumn("__i", inside).join(size, [by, "__c"])
            .withColumn(out, F.col("__before") + F.col("__i")).drop("__h", "__c", "__n", "__before", "__i"))


def place(docs: DataFrame, link_cols: str | Sequence[str], shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Documents that share a value of a link column are kept together as far as equal counts allow; a null links with
    nothing, nor do equal values of different columns. Repeated rows and ids are placed one by one. An empty table stays
    empty. Columns named like the results are replaced. ``docs`` should be narrow (no texts): it travels through every
    shuffle but those of the rounds.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    names = [link_cols] if isinstance(link_cols, str) else list(link_cols)
    docs = docs.drop("shard", "slot")
    rows = ws.keep(docs.withColumn("__node", F.monotonically_increasing_id()))
    total = rows.count()
    room = _quota(total, shards)
    keys = F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(k), F.col(c))) for k, c in enumerate(names)])
    links = ws.keep(rows.select(F.col("__node").alias("node"), F.explode(F.array_compact(keys)).alias("link")))
    several = ws.keep(links.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    linked = ws.keep(salted_join(links, several, ["link"], ["node"]))
    first = linked.groupBy("node").agg(F.min(F.struct("link", "n")).alias("first"))
    linked = linked.join(first, "node") if len(names) > 1 else linked.withColumn("first", F.struct("link", "n"))
    edges = ws.keep(linked.select(
        "node", "link", F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("blocks"),
        (F.col("link") == F.col("first.link")).cast("int").alias("one"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")))
    done = propagate(ws, edges, [int(n * (1 + SLACK)) for n in room]).where("one = 1")
    # what leaves a shard leaves by its link; a link of very many rows goes by the row
    wide = several.where(F.col("n") > ROWS_PER_CHUNK // 8).select("link", F.lit(True).alias("wide"))
    done = salted_join(done, wide, ["link"], ["node"], "left").select(
        F.col("node").alias("__node"), F.col("shard").alias("__label"), F.when(F.col("wide").isNull(), F.col("link")).alias("__group"))
    labelled = rows.join(done, "__node", "left").withColumns(
        {"__label": F.coalesce("__label", F.lit(-1)), "__group": F.coalesce("__group", F.xxhash64("__node"))})
    labelled = ws.keep(ranked(ws, ws.keep(labelled), "__label", "__group", "__rank"))
    held = {r[0]: r[1] for r in labelled.groupBy("__label").count().collect()}
    full = [j for j in range(shards) if held.get(j, 0) > room[j]]
    own = [min(held.get(j, 0), room[j]) for j in range(shards)]
    if full:  # the last whole group within the quota
        ends = labelled.where(F.col("__label").isin(full)).groupBy("__label", "__group").agg((F.max("__rank") + 1).alias("end"))
        whole = {r[0]: r[1] for r in ends.where(F.col("end") <= _pick(room, F.col("__label"))).groupBy("__label").agg(F.max("end")).collect()}
        own = [whole.get(j, 0) if j in full else own[j] for j in range(shards)]
    over, spill = [], 0
    for j in range(shards):
        over.append(spill - own[j])
        spill += held.get(j, 0) - own[j]
    gaps = [room[j] - own[j] for j in range(shards)]
    by_gap = sorted(range(shards), key=lambda j: (-gaps[j], j))  # groups that left go first, into the widest gaps
    start = {j: sum(gaps[i] for i in by_gap[:k]) for k, j in enumerate(by_gap)}
    label = F.col("__label")
    at = F.greatest(label, F.lit(0))
    settled = (label >= 0) & (F.col("__rank") < _pick(own, at))
    free = F.col("__rank") + F.when(label < 0, F.lit(spill).cast("long")).otherwise(_pick(over, at))
    dealt = F.lit(by_gap[-1])
    for j in reversed(by_gap):
        dealt = F.when(F.col("__free") < start[j] + gaps[j], F.lit(j)).otherwise(dealt)
    first = [own[j] - start[j] for j in range(shards)]
    out = labelled.withColumn("__free", free).withColumn("shard", F.when(settled, label).otherwise(dealt).cast("int"))
    return out.withColumn("slot", F.when(settled, F.col("__rank")).otherwise(F.col("__free") + _pick(first, F.col("shard")))
                          .cast("long")).drop("__node", "__label", "__group", "__rank", "__free")


def cut_links(placed: DataFrame, link_cols: str | Sequence[str]) -> DataFrame:
    """(link_col, link, n, shards, cut) for every link between documents in different shards: its documents, the shards
    they are in, and how many pairs of them are parted. Nulls link with nothing; an uncut link has no row."""
    def one(c):
        counts = placed.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("link"), "shard").agg(F.count(F.lit(1)).alias("n"))
        pairs = (F.sum(F.col("n")).cast("decimal(38,0)") * F.sum("n") - F.sum(F.col("n").cast("decimal(19,0)") * F.col("n"))) / 2
        return (counts.groupBy("link").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("shards"), pairs.cast("decimal(38,0)").alias("cut"))
                .where("shards > 1").select(F.lit(c).alias("link_col"), "link", F.col("size").alias("n"), "shards", "cut"))

    return reduce(DataFrame.unionByName, [one(c) for c in ([link_cols] if isinstance(link_cols, str) else link_cols)])


def text_facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with size (UTF-8 bytes and one), text_crc32, and text_link (null for a null text), without the text."""
    text = F.col(text_col).cast("string")
    return docs.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
                             "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
                             "text_link": F.when(text.isNotNull(), F.xxhash64(text))})
