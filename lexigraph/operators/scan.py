"""Scans of texts by line: search, counts, windows, heads and tails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_per_group, merged_intervals, with_context


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, text): lines from 1; one empty line at the end isn't one."""
    parts = F.split(F.col(text), "\n")
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return docs.select(F.col(doc).alias("doc"), F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def line_match(pattern: str, *, literal: bool = False, ignore_case: bool = True) -> Column:
    p = re.escape(pattern) if literal else pattern
    return F.col("text").rlike(("(?i)" if ignore_case else "") + p)


def search(docs: DataFrame, pattern: str, *, per_doc: int = 500, literal: bool = False, ignore_case: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, text) of matching lines, the first `per_doc` of each. Whole texts are tested first, so only those with a match are
    cut into lines."""
    p = ("(?i)" if ignore_case else "") + (re.escape(pattern) if literal else pattern)
    hits = text_lines(docs.where(F.col(text).rlike(p)), doc, text).where(line_match(pattern, literal=literal, ignore_case=ignore_case))
    return first_per_group(hits, ("doc",), ["line"], per_doc)


def match_counts(docs: DataFrame, pattern: str, *, ignore_case: bool = True, text: str = "text") -> DataFrame:
    """(matches, files): all matches, several in a line too."""
    n = F.regexp_count(F.col(text), F.lit(("(?i)" if ignore_case else "") + pattern))
    return docs.agg(F.coalesce(F.sum(n), F.lit(0)).alias("matches"), F.count_if(n > 0).alias("files"))


def search_with_context(docs: DataFrame, pattern: str, around: int, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    lines = text_lines(docs.where(F.col(text).rlike("(?i)" + pattern)), doc, text)
    return with_context(lines, ("doc",), "line", line_match(pattern), around, around)


def head(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("line") <= n)


def tail(lines: DataFrame, n: int) -> DataFrame:
    return first_per_group(lines, ("doc",), [F.desc("line")], min(n, 50_000))


def page(lines: DataFrame, offset: int, length: int) -> DataFrame:
    """(doc, content, n, more): lines after the first `offset`."""
    rows = lines.where((F.col("line") > offset) & (F.col("line") <= offset + length + 1))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["line"] <= offset + length)
    return rows.groupBy("doc").agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("content"), F.size(kept).alias("n"), (F.max("line") > offset + length).alias("more"))


def numbered(lines: DataFrame, budget: int) -> DataFrame:
    """(doc, shown): `N. text` lines, as many whole ones as fit."""
    rows = lines.withColumn("row", F.concat(F.col("line").cast("string"), F.lit(". "), "text"))
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.length("row") + 1).over(w)).where(F.col("used") <= budget)
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("shown"))


def read_windows(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, line, text, window): lines in the windows (doc, start, end), windows merged where they meet. A window is unfolded to its
    lines, so the join is by equality."""
    merged = merged_intervals(windows, ("doc",))
    wanted = merged.select("doc", F.col("start").alias("window"), F.explode(F.sequence("start", "end")).alias("line"))
    return lines.join(wanted, ["doc", "line"])
