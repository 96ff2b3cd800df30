"""From raw documents to placed training rows: quality, near duplicates, benchmark leaks, source mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``; whatever else a table holds goes along. Rows without a
doc_id can't be named in a stage's verdict: near duplicates and benchmark leaks leave them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import decontam, jaccard, mixing, quality, sharding
from fieldbook.llm.common import Workspace, small, table
from fieldbook.session import prepare

LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``LEAST_QUALITY``, by a model of the labelled ones. Null and empty texts get the
    share of good ones in training as score."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), label_col="quality")
    return quality.scored(docs, model, out="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one of least id. Rows that repeat an id are documents of
    their own if their texts differ: they go by a hash of id and text, and of equal ones a single row stays."""
    prepare(spark)
    ws = Workspace(spark, "pipeline")
    again = ws.keep(docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("__id").isNotNull() & (F.col("n") > 1)).select("__id"))
    repeats = again.limit(1).count() > 0
    rows = docs.withColumn("__row", F.col("doc_id").cast("long"))
    if repeats:
        flag = small(again.withColumn("__again", F.lit(True)))
        rows = docs.join(flag, F.col("doc_id") == F.col("__id"), "left").withColumn(
            "__row", F.when(F.col("__again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = ws.keep(jaccard.link_components(rows, id_col="__row"))
    out = ws.keep(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__out")).distinct())
    left = rows.join(small(out), F.col("__row") == F.col("__out"), "left_anti")
    if not repeats:
        return left.select(*docs.columns)
    return left.where(F.col("__again").isNull()).unionByName(left.where("__again").dropDuplicates(["__row"])).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, substitutions allowed."""
    prepare(spark)
    ws = Workspace(spark, "pipeline")
    found = ws.keep(decontam.overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("__id")).distinct())
    return docs.join(small(found), F.col("doc_id") == F.col("__id"), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, by tempered source weights."""
    prepare(spark)
    return mixing.mix(docs).select(*docs.columns)


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): equal texts together, shard counts one apart at most."""
    prepare(spark)
    narrow = sharding.text_facts(docs).select("doc_id", "source", "size", "text_crc32", "text_link")
    return sharding.place(narrow, "text_link").select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("decontamination", no_benchmark),
          ("mixing", mixed_sources), ("sharding", placed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline-stages")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.keep(docs)
    return docs
