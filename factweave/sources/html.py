"""Anchors and snippets of HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip

ANY_ANCHOR = r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'


def anchors(pages: DataFrame, key: str, html: str, pattern: str = V.SNIPPET_ANCHOR, limit: int | None = None) -> DataFrame:
    """(key, position, url, snippet) of the anchors matching `pattern`, tags removed from the text."""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    if limit is not None:
        found = F.slice(found, 1, limit)
    rows = pages.select(key, F.posexplode(found).alias("position", "a"))
    return rows.select(key, "position", "a.url", strip(F.regexp_replace("a.inner", "<[^>]+>", "")).alias("snippet"))
