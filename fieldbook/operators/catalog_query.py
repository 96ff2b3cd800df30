"""The query-parameter surface of open-data catalogs as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import keys


def catalog_query(df: DataFrame, select: Sequence[str] | None = None, where: Column | None = None,
                  full_text: str | None = None, text_columns: Sequence[str] = (), group: Sequence[str] | None = None,
                  order: Sequence[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Select, where, full text over columns, group with count ``n``, order and limit, in that order.

    An order with a limit becomes one top-k step; the where part reaches the scan.
    """
    if where is not None:
        df = df.where(where)
    if full_text:
        df = df.where(keys.has_words(F.lit(full_text), F.concat_ws(" ", *text_columns)))
    if group:
        df = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    elif select:
        df = df.select(*select)
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)
