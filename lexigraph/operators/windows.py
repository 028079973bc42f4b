"""Ordered and interval operators: budgets, context, merges, runs, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, by: tuple[str, ...], order: list, size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose sizes sum to the budget at most; the sum only grows, so it is cut once."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def merged_intervals(rows: DataFrame, by: tuple[str, ...], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """(by..., start, end): intervals that overlap or lie within `gap` of each other, as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("__new", F.coalesce((F.col(start) > before + gap).cast("int"), F.lit(1)))
    islands = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def runs(rows: DataFrame, by: tuple[str, ...], order: str, value: str) -> DataFrame:
    """(by..., value, start, end, n): runs of equal values over consecutive numbers."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*by, value).orderBy(order))
    return rows.withColumn("__island", island).groupBy(*by, value, "__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("__island")


def with_context(rows: DataFrame, by: tuple[str, ...], order: str, hit: Column, before: int, after: int) -> DataFrame:
    """Hits and the rows around them, `is_context` for those that are none, `gap` where the row before is left out."""
    w = Window.partitionBy(*by).orderBy(order)
    near = F.max(hit.cast("int")).over(w.rowsBetween(-after, before)) == 1
    kept = rows.withColumn("is_context", ~hit).withColumn("__near", near).where("__near").drop("__near")
    return kept.withColumn("gap", F.coalesce(F.col(order) > F.lag(order).over(w) + 1, F.lit(False)))


def first_per_group(rows: DataFrame, by: tuple[str, ...], order: list, most: int) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def share_of(rows: DataFrame, by: tuple[str, ...], value: Column, name: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by))
    return rows.withColumn(name, F.when(total > 0, value / total).otherwise(0.0))


def water_filled(rows: DataFrame, by: tuple[str, ...], key: str, size: str, budget: int, *, room: float = 1.15, extra: int = 200) -> DataFrame:
    """(by..., key, size, granted): by rising size each gets what it needs with some room, at most an equal share of what is left.
    One group is one request's files, a list of some dozens."""
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(size).cast("long").alias("s"), F.col(key).alias("k")))).alias("items"))
    kind = "struct<rest:bigint,left:int,out:array<bigint>>"
    start = F.struct(F.lit(budget).cast("long").alias("rest"), F.size("items").alias("left"), F.array().cast("array<bigint>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        share = F.floor(acc["rest"] / acc["left"])
        need = F.least(F.ceil(x["s"] * room), share)
        return F.struct((acc["rest"] - need).alias("rest"), (acc["left"] - 1).alias("left"), F.concat(acc["out"], F.array(need + extra)).alias("out")).cast(kind)

    out = lists.withColumn("granted", F.aggregate("items", start, step)["out"])
    return out.select(*by, F.explode(F.arrays_zip("items", "granted")).alias("x")).select(*by, F.col("x.items.k").alias(key), F.col("x.items.s").alias(size), F.col("x.granted").alias("granted"))


def tiered_budget(rows: DataFrame, by: tuple[str, ...], budget: int, *, tier: str = "tier", score: str = "score", reserve: float = 0.05, least: int = 10) -> DataFrame:
    """The rows with `granted`: tiers high, medium and low share 60, 30 and 10 % of what the reserve leaves, a tier's rows by their
    scores (evenly if they have none), at least 10 each; other tiers get nothing."""
    share = F.create_map(*[x for k, v in (("high", 0.6), ("medium", 0.3), ("low", 0.1)) for x in (F.lit(k), F.lit(v))])[F.col(tier)]
    w = Window.partitionBy(*by, tier)
    part = F.when(F.sum(score).over(w) > 0, F.col(score) / F.sum(score).over(w)).otherwise(1.0 / F.count("*").over(w))
    whole = F.lit(float(budget)) * (1 - reserve)
    return rows.withColumn("granted", F.when(share.isNull(), 0).otherwise(F.greatest(F.lit(least), F.floor(whole * share * part))).cast("long"))
