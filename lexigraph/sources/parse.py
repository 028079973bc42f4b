"""Parsing sources: embedded languages in pages, and symbols of Python files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def injections(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, pos, tag, language, body): contents of script and style elements in order."""
    p = r"(?s)<(script|style)[^>]*>(.*?)</(script|style)>"
    tags, bodies = (F.regexp_extract_all(F.col(html), F.lit(p), F.lit(k)) for k in (1, 2))
    rows = pages.select(doc, F.posexplode(F.arrays_zip(tags.alias("tag"), bodies.alias("body"))).alias("pos", "x")).select(doc, "pos", "x.tag", "x.body")
    return rows.withColumn("language", F.when(F.col("tag") == "script", "javascript").otherwise("css"))
