"""Mixing sources to target weights, with DataFrame functions only.

A source's target is its weighted share of the budget, at most `most` times its size; what a capped source can't take is shared
again by weight among the others (water filling). A source first gets as many complete epochs as fit. The rest is a weighted
sample without replacement by Efraimidis and Spirakis: each document draws an exponential key divided by its quality weight, and
documents are taken in the order of their keys until their sizes reach what is left; the document at the edge is taken if that
comes nearer to the target.

No source is sorted in one task, however large. The sizes of ranges of keys, 64 for each doubling, are summed for each source
before any shuffle, and the range that holds the edge is cut into 1024 again; ranges below it are taken, ranges above are not, and
only documents of the last range are sorted. Ranges by doublings tell keys apart however small the weights. So each row is decided
where it lies, but for those of the last ranges, and texts aren't shuffled.

Nulls: a null text has no words, a null source is a source of its own and sorts last, a null id draws the key of its text and
source. Each row is decided on its own; rows that are the same draw the same key, and which of them is taken is no difference.
Documents without words, or sources without any, take nothing. Texts of any length are counted whole. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
DOUBLING = 64
RANGES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of characters that aren't symbols; the least for a null or empty text."""
    n = F.char_length(text)
    return F.when(n > 0, F.greatest(F.lit(0.05), F.char_length(F.translate(text, "#$%&*!@^|~<>{}[]", "")).cast("double") / n)).otherwise(F.lit(0.05))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Weights repeat over the sources in code-point order. A source is capped where its cap is below the level of the water, so
    with sources ordered by cap over weight the capped ones come first, and the level after the k-th is a matter of running sums."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    all_ = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    water = left / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", water).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # The level of the first source that its share doesn't fill holds for all from there on.
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(all_)
    share = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", share.alias("target"))


def uniform(seed: int, *values: Column) -> Column:
    """A number in (0, 1) from the values: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in values)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def exponential_key(seed: int, doc_id: Column, source: Column, text: Column, quality: Column | None) -> Column:
    """-ln(u) / quality: who has the least keys makes a weighted sample without replacement. quality null or not positive: 1e-6."""
    weight = F.lit(1.0) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))
    return -F.ln(uniform(seed, F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary"))), source)) / weight


def ranges(key: Column) -> tuple[Column, Column]:
    """The range of a key and the part of it: 64 ranges a doubling, each of 1024 parts."""
    at = F.log2(key)
    return F.floor(at * DOUBLING), F.floor(at * (DOUBLING * RANGES))


class Mix:
    """What the mix takes, as one row for each source: (s, source_size, target, epochs, rest, edge_r1, edge_r2, before_r2)."""

    def __init__(self, docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 17) -> None:
        id_, self.source, self.text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
        self.id, self.size = id_, word_count(self.text)
        self.key = exponential_key(seed, id_, self.source, self.text, quality)
        rows = docs.select(id_.alias("doc_id"), self.source.alias("source"), self.size.alias("size"), self.key.alias("key"))
        rows = rows.withColumn("r1", ranges(F.col("key"))[0]).withColumn("r2", ranges(F.col("key"))[1])
        self.rows = materialise(rows)
        cells = materialise(self.rows.groupBy("source", "r1").agg(F.sum("size").alias("size")))
        sources = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, budget=budget, most=most)
        sources = materialise(
            sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
            .withColumnRenamed("source", "s")
        )

        def edge(cells: DataFrame, sources: DataFrame, name: str, before: str) -> DataFrame:
            """For each source, the first range at whose end the sizes reach the rest, and what comes before it."""
            w = Window.partitionBy("source").orderBy(name)
            sums = cells.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.coalesce(F.col(before), F.lit(0)) + F.sum("size").over(w))
            first = sums.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct(name, F.col("upto") - F.col("size"))).alias("e"))
            return first.select(F.col("source").alias("z"), F.col("e")[name].alias(f"edge_{name}"), F.col("e")["col2"].alias(f"before_{name}"))

        start = sources.withColumn("zero", F.lit(0))
        one = materialise(start.join(edge(cells, start, "r1", "zero"), F.col("s").eqNullSafe(F.col("z")), "left").drop("z", "zero"))
        inner = self.rows.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.col("r1") == F.col("edge_r1")))
        fine = inner.groupBy("source", "r2").agg(F.sum("size").alias("size"))
        self.edges = materialise(one.join(edge(fine, one, "r2", "before_r1"), F.col("s").eqNullSafe(F.col("z")), "left").drop("z"))

    def decided(self, rows: DataFrame, size: Column) -> DataFrame:
        """rows (doc_id, source, key, r1, r2, ...) with `times`, how often each is taken, and its source's columns. size: of a row of
        the last range, which alone are sorted."""
        joined = rows.join(self.edges, F.col("source").eqNullSafe(F.col("s")), "left")
        # What is below the edge is in, what is above is out; a source without an edge has no rest to fill.
        at_edge = F.coalesce(F.col("r2") == F.col("edge_r2"), F.lit(False))
        below = F.coalesce((F.col("r1") < F.col("edge_r1")) | ((F.col("r1") == F.col("edge_r1")) & (F.col("r2") < F.col("edge_r2"))), F.lit(False))
        plain = joined.where(~at_edge).withColumn("times", (F.col("epochs") + below.cast("long")).cast("int"))
        last = Window.partitionBy("source", "r2").orderBy("key", F.col("doc_id").asc_nulls_last(), "edge_size").rowsBetween(Window.unboundedPreceding, 0)
        middle = joined.where(at_edge).withColumn("edge_size", size).withColumn("upto", F.col("before_r2") + F.sum("edge_size").over(last))
        chosen = (F.col("upto") - F.col("edge_size") + F.col("edge_size") / 2.0 <= F.col("rest")).cast("long")
        return plain.unionByName(middle.withColumn("times", (F.col("epochs") + chosen).cast("int")).drop("upto", "edge_size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs`. quality: a column of weights over 0, 1 if none is given (null or
    not positive: the least weight, 1e-6); see `Mix`."""
    m = Mix(docs, **options)
    return m.decided(m.rows, F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs`, all columns, as often as it is taken; rows of which nothing is taken, or without words, go. A
    row is decided by itself, so ids may repeat."""
    options.setdefault("quality", plain_share(F.col("text")))
    m = Mix(docs, **options)
    has_words = m.text.rlike(WORD)
    whole = docs.where(has_words).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), m.id.alias("doc_id"), m.source.alias("source"), m.key.alias("key"))
    whole = whole.withColumn("r1", ranges(F.col("key"))[0]).withColumn("r2", ranges(F.col("key"))[1])
    taken = m.decided(whole, word_count(F.col("row.text").cast("string"))).where("times > 0")
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
