"""How a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registry() -> tuple[dict, Callable]:
    found: dict = {}

    def query(sql: str | None = None) -> Callable:
        def register(f: Callable[[Tables], DataFrame]) -> Callable:
            found[f.__name__] = (lambda spark, folder: f(Tables(spark, folder)), sql)
            return f

        return register

    return found, query
