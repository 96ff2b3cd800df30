"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates.

Paragraphs are lines. A multinomial logistic regression over word 1- and 2-grams, present or not, tells licence families
from each other and from ordinary paragraphs. It is trained by Spark's own estimator on the templates, on generated
variants of them (words left out), and on a bounded sample of the corpus's paragraphs as the class of no licence. The
vocabulary is the templates' n-grams less those that are frequent in that sample. A paragraph that holds none of it gets
the intercept alone, which is no licence, so such paragraphs need no scoring; that is exact.

A prediction below the calibrated probability is ``unknown``. The limit is the least at which held-out variants and held-out
ordinary paragraphs are told apart with the wished precision. Predictions are then compared with the family's
template: the share of its 2-grams that stand in the paragraph must confirm them, or the family is ``unknown`` too.
DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices of public licences.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
]
NONE, UNKNOWN = "none", "unknown"
SAMPLE = 2000  # ordinary paragraphs that the model is fitted on, at most
LONGEST_EXAMPLE = 4000  # characters of one of them; paragraphs of any length are scanned
VARIANTS = 12
PRECISION = 0.99
CONFIRM = 0.6
COMMON = 0.01  # share of ordinary paragraphs from which an n-gram is no evidence


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbours. ``w`` is bound to a variable first, or it would be evaluated for every word."""

    def both(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))

    return F.element_at(F.transform(F.array(w), both), 1)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, paragraph), lines from 0; blank ones are left out."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\r?\n", -1)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("line", "paragraph")).where(F.trim("paragraph") != "")


@dataclass
class Scanner:
    vocabulary: list[str]
    families: list[str]
    regression: LogisticRegressionModel
    limit: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``grams`` get ``family`` (none included) and ``probability``."""
        vec = CountVectorizerModel.from_vocabulary(self.vocabulary, "grams", "features")
        p = vector_to_array("probability")
        names = F.array(*[F.lit(f) for f in self.families])
        out = self.regression.transform(vec.transform(rows)).withColumn("__p", p)
        best = F.array_position("__p", F.array_max("__p")).cast("int")
        return out.withColumns({"family": F.element_at(names, best), "probability": F.array_max("__p")}).drop(
            "features", "rawPrediction", "prediction", "__p")


def _templates(spark) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "t int, family string, paragraph string")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scanner:
    """Fit on at most ``sample`` ordinary paragraphs, those of least hash. A table without any gives a model of the
    templates alone."""
    spark = docs.sparkSession
    templates = _templates(spark)
    key = F.xxhash64("paragraph")
    plain = paragraphs(docs, id_col, text_col).where(~F.lower("paragraph").rlike("licen[sc]e|copyright|all rights reserved"))
    plain = plain.where(F.length("paragraph") <= LONGEST_EXAMPLE).select("paragraph").orderBy(key, "paragraph").limit(sample).withColumn("family", F.lit(NONE))
    plain = spark.createDataFrame(plain.collect() or [], "paragraph string, family string")
    variants = templates.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS)))).withColumn("w", words(F.col("paragraph")))
    kept = F.filter("w", lambda x, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(x, i, F.col("v"), F.col("t")), F.lit(8)) > 0))
    known = variants.select("family", "v", grams(kept).alias("grams"))
    rows = known.unionByName(plain.select("family", F.pmod(key, F.lit(VARIANTS + 1)).cast("int").alias("v"), grams(words(F.col("paragraph"))).alias("grams")))
    count = F.count(F.lit(1))
    ordinary = (plain.select(F.explode(grams(words(F.col("paragraph")))).alias("g")).groupBy("g").agg(count.alias("n"))
                .where(F.col("n") > F.lit(COMMON * max(plain.count(), 1))))
    vocabulary = [r["g"] for r in templates.select(F.explode(grams(words(F.col("paragraph")))).alias("g")).distinct()
                  .join(ordinary, "g", "left_anti").orderBy("g").collect()]
    families = [NONE, *dict.fromkeys(f for f, _ in TEMPLATES)]
    label = F.coalesce(*[F.when(F.col("family") == f, F.lit(float(i))) for i, f in enumerate(families)])
    vec = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    ready = vec.transform(rows.withColumn("label", label)).withColumn("weight", F.when(F.col("family") == NONE, 1.0).otherwise(4.0))
    regression = LogisticRegression(maxIter=60, regParam=0.002, weightCol="weight", family="multinomial").fit(ready.where("v % 4 != 3 or v = 0"))
    scanner = Scanner(vocabulary, families, regression, 0.0)
    held = scanner.scored(rows.where("v % 4 = 3").withColumnRenamed("family", "truth")).select("truth", "family", "probability").collect()
    scanner.limit = calibrated([(r["probability"], r["family"] == r["truth"]) for r in held if r["family"] != NONE])
    return scanner


def calibrated(judged: list[tuple[float, bool]], precision: float = PRECISION) -> float:
    """The least probability from which on predictions are right with ``precision``; 0.5 at least."""
    right, limit = 0, 1.0
    for k, (p, ok) in enumerate(sorted(judged, reverse=True)):
        right += ok
        if right >= precision * (k + 1):
            limit = p
    return max(0.5, limit if judged else 0.5)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, family, probability, likeness): paragraphs that are a licence notice. ``family`` is ``unknown`` where
    the probability is below the calibrated limit or the template isn't confirmed; ``likeness`` is the greatest share of
    a template's pairs of words that the paragraph holds.

    Null, empty and blank texts have no paragraph. Repeated rows give repeated findings. An empty table gives no rows.
    """
    spark = docs.sparkSession
    p = paragraphs(docs, id_col, text_col)
    single = [g for g in scanner.vocabulary if " " not in g]
    some = r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted((g.replace(".", r"\.") for g in single), key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    likely = p.where(F.lower("paragraph").rlike(some)).withColumn("grams", grams(words(F.col("paragraph"))))
    found = scanner.scored(likely).where(F.col("family") != NONE)
    pairs = lambda c: F.filter(c, lambda g: F.contains(g, F.lit(" ")))
    shapes = [(r["family"], r["g"]) for r in _templates(spark).select("family", pairs(grams(words(F.col("paragraph")))).alias("g")).collect()]
    like = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(F.col("family") == f, F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in g]))) / len(g))
                                                .otherwise(0.0) for f, g in shapes])
    found = found.withColumn("likeness", like)
    sure = (F.col("probability") >= scanner.limit) & (F.col("likeness") >= CONFIRM)
    return found.select("id", "line", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
                        F.round("probability", 6).alias("probability"), F.round("likeness", 6).alias("likeness"))
