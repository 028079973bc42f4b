"""Rank fusion, tolerance groups and what follows a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import summary

RRF_K = 10


def weighted_rrf(a: DataFrame, b: DataFrame, alpha: Column | float, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """(by..., doc, score, rank) from two rankings (by..., doc, rank): alpha / (10 + rank in a) + (1 - alpha) / (10 + rank in b); who is
    missing ranks one behind that list's last. Scores within 1e-9 are ordered by key."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    last = lambda r, name: r.groupBy(*by).agg((F.max("rank") + 1).alias(name))
    joined = a.select(*by, "doc", F.col("rank").alias("ra")).join(b.select(*by, "doc", F.col("rank").alias("rb")), [*by, "doc"], "full_outer")
    joined = joined.join(last(a, "na"), list(by), "left").join(last(b, "nb"), list(by), "left")
    one = F.lit(1)
    score = alpha / (RRF_K + F.coalesce("ra", "na", one)) + (1 - alpha) / (RRF_K + F.coalesce("rb", "nb", one))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "doc")
    return joined.select(*by, "doc", score.alias("score")).withColumn("rank", F.row_number().over(order))


def alpha_schedule(turn: Column, workspace: Column, conversation: Column, roots_changed: Column, mentioned: Column) -> Column:
    """How much the workspace counts against the conversation: less by the turn, less still if little is known of it, little when a
    tool is named, and much when the roots have changed."""
    base = F.greatest(F.lit(0.15), 0.85 * F.exp(-0.25 * turn))
    base = F.when(workspace < 0.45, F.greatest(F.lit(0.15), base - 0.2)).otherwise(base)
    base = F.when(mentioned & (conversation >= 0.70), 0.15).otherwise(base)
    return F.when(roots_changed, F.greatest(base, F.lit(0.80))).otherwise(base)


def tolerance_groups(ranked: DataFrame, by: tuple[str, ...], *, key: str = "key", score: str = "score", specificity: str = "specificity", tolerance: float = 0.05) -> DataFrame:
    """(by..., key, group, position). By falling score, a group goes on while scores are within the tolerance of its first; in a group
    the more specific come first. The fold runs over one ranking, as long as what a search returns."""
    item = F.struct((-F.col(score)).alias("neg"), F.col(key).alias("key"), F.col(score).alias("score"), F.col(specificity).alias("specificity"))
    lists = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = "struct<anchor:double,g:int,out:array<int>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["anchor"] - x["score"] < tolerance, F.lit(False))
        g = F.when(same, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(x["score"]).alias("anchor"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out")).cast(kind)

    folded = lists.withColumn("groups", F.aggregate("items", start, step)["out"])
    rows = folded.select(*by, F.explode(F.arrays_zip("items", "groups")).alias("x")).select(*by, F.col("x.items.key").alias("key"), F.col("x.groups").alias("group"), F.col("x.items.specificity").alias("s"))
    return rows.select(*by, "key", "group", F.row_number().over(Window.partitionBy(*by).orderBy("group", F.desc("s"), "key")).alias("position"))


def first_tier(tiers: list[DataFrame], by: tuple[str, ...] = ("query",)) -> DataFrame:
    """Of rankings in order of preference, for each query the rows of the first that has any, with `tier` from 1."""
    every = None
    for k, rows in enumerate(tiers, 1):
        rows = rows.withColumn("tier", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    return every.withColumn("__best", F.min("tier").over(Window.partitionBy(*by))).where("tier = __best").drop("__best")


def assembled(ranked: DataFrame, by: tuple[str, ...] = ("query",), *, full: int = 3, most: int = 20, text: str = "text") -> DataFrame:
    """The `most` best with `shown`: the whole text for the first, its summary for the others, and the tier."""
    rows = ranked.where(F.col("rank") <= most)
    return rows.withColumn("tier", F.when(F.col("rank") <= full, "full").otherwise("summary")).withColumn("shown", F.when(F.col("rank") <= full, F.col(text)).otherwise(summary(F.col(text))))


def passthrough(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", F.lit(1.0)).withColumn("tier", F.lit("full"))
