"""Versioned state and changes to tables.

Every change is a new table made from the old one, written beside it and swapped in by the caller; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replaced(table: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of `new` in place of those with the same key; of several new ones with a key any."""
    return table.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new.dropDuplicates(list(key)))


def without_children(child: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """A child table after its parents are gone (ON DELETE CASCADE)."""
    return child.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def nulled(child: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """A child table whose references to what is gone are null (ON DELETE SET NULL)."""
    dead = gone.select(F.col(key).alias("__key")).distinct().withColumn("__dead", F.lit(True))
    return child.join(dead, F.col(column) == F.col("__key"), "left").withColumn(column, F.when(F.col("__dead"), None).otherwise(F.col(column))).drop("__key", "__dead")


def upsert_with_cascade(parent: DataFrame, new: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replacing a parent row deletes it first: rows of child tables that refer to it go too, and come back only by being written
    again."""
    return replaced(parent, new, (key,)), {name: without_children(df, new, column, key) for name, (df, column) in children.items()}


def insert_or_ignore(table: DataFrame, new: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The table with those new rows whose key isn't there; of equal keys among the new the first. A key with a null is equal to none."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    first = new.where(whole).withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")
    return table.unionByName(first.join(table.select(*key), list(key), "left_anti").select(*table.columns)).unionByName(new.where(~whole).select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of the change of the same key."""
    cols = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in cols)), F.col(key) == F.col("__key"), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns))


def history(versions: DataFrame, by: tuple[str, ...], created: str, *ties: str) -> DataFrame:
    """With `version`, 0 for the newest."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(created), *ties)) - 1)


def pruned(versions: DataFrame, created: str, as_of: Column, ttl: str = "24 hours") -> DataFrame:
    return versions.where(F.col(created) >= as_of - F.expr(f"INTERVAL {ttl}"))


def stale(indexed: DataFrame, visited: DataFrame, key: str = "path") -> DataFrame:
    return indexed.join(visited.select(key), key, "left_anti")


def changed(indexed: DataFrame, now: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """What is new or has another content hash than when it was indexed."""
    return now.join(indexed.select(key, F.col(digest).alias("__was")), key, "left").where(~F.col(digest).eqNullSafe(F.col("__was"))).drop("__was")


def stash_attempts(stash: DataFrame, attempts: DataFrame, most: int = 2) -> DataFrame:
    """(id, attempts): entries with their attempts so far; those that have used them up are gone."""
    counted = attempts.groupBy("id").agg(F.count("*").alias("attempts"))
    return stash.join(counted, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).where(F.col("attempts") < most)


def line_overlap(old: Column, new: Column) -> Column:
    """How many lines of one text are in another."""
    return F.size(F.filter(F.split(old, "\n"), lambda x: F.array_contains(F.split(new, "\n"), x)))
