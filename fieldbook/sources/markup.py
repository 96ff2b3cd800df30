"""Archived web pages to visible text."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags whose content is never shown, and tags that break a line.
HIDDEN = ["iframe", "noscript", "script", "style", "svg", "template"]
BREAKING = ["article", "aside", "blockquote", "br", "dd", "div", "dt", "figcaption", "footer", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "td", "th",
            "title", "tr", "ul"]


# A tag's end is the first ">" outside quotes.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_COMMENT = r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*+>"
_UNSEEN = rf"(?is)<({'|'.join(HIDDEN)})(?![^\s/>]){_REST}.*?(?:</\1\s*>|\z)"
_BREAK = rf"(?i)</?(?:{'|'.join(BREAKING)})(?![^\s/>]){_REST}"
_TAG = rf"</?[a-zA-Z][^\s/>]*+{_REST}"


@F.pandas_udf(T.StringType())
def _characters(s: pd.Series) -> pd.Series:
    """Character references to characters, the one step without an expression in Spark."""
    from html import unescape

    return s.map(lambda t: None if t is None else unescape(t))


def visible_text(html: Column | str) -> Column:
    """Visible text lines of a page: hidden elements and tags out, a line for each block, white space squeezed.

    An element that is never closed hides the rest of the page. Null stays null.
    """
    c = F.col(html) if isinstance(html, str) else html
    for pattern, by in ((_COMMENT, ""), (_UNSEEN, ""), (_BREAK, "\n"), (_TAG, "")):
        c = F.regexp_replace(c, pattern, by)
    lines = F.transform(F.split(_characters(c), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def text_lines(df: DataFrame, keep: Sequence[str], text: Column | str, sep: str = "\n") -> DataFrame:
    """One row per line with a 1-based ``line_no``."""
    c = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, F.posexplode(F.split(c, sep)).alias("__i", "line")).select(
        *keep, (F.col("__i") + 1).alias("line_no"), "line")


def page_lines(pages: DataFrame, keep: Sequence[str], html: str) -> DataFrame:
    """Visible lines of HTML pages."""
    return text_lines(pages.withColumn("__t", visible_text(html)), keep, "__t").where(F.col("line") != "")
