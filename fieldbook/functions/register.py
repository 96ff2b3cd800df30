"""SQL names for the pluggable parts: the agenda segmenter as a table function, rule tables by first match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 1000


def register_functions(spark: SparkSession) -> None:
    """Register ``agenda_items(body)``, a table function for SQL ``LATERAL`` use, made of Spark expressions."""
    from fieldbook.operators.agendas import items_sql
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION agenda_items(body STRING)
      RETURNS TABLE (item_no INT, number STRING, title STRING, section STRING)
      RETURN SELECT pos, col.number, col.title, col.section FROM posexplode({items_sql("body")})""")


def rules_column(rules: Sequence[tuple[str, str]], text: Column, default: str | None) -> Column:
    """Rows of (pattern, label) as one Column; the first pattern that occurs decides."""
    chain = None
    for pattern, label in rules:
        cond = text.rlike(pattern)
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def label_by_rules(items: DataFrame, body: str, rules: DataFrame, order: str, pattern: str, label: str, out: str,
                   default: str | None = None) -> DataFrame:
    """``items`` with a column ``out``: the label of the first rule, by ``order``, whose pattern occurs in ``body``.

    Rules are rows of a table, so a change of rows changes the result without code. They are written by hand and become
    one chain of conditions inside the plan, which reads a text once and needs no join; more than ``MOST_RULES`` of them
    raise. Rules without a pattern are passed over, ties of the order go by pattern and label, and a null text gets the default.
    """
    if not {order, pattern, label} <= set(rules.columns):
        raise ValueError(f"a rule table needs the columns {order}, {pattern} and {label}")
    rows = rules.where(F.col(pattern).isNotNull()).orderBy(order, pattern, label).select(pattern, label).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return items.withColumn(out, rules_column([(r[0], r[1]) for r in rows], F.col(body), default))
