"""The ranking-event log: JSON lines, some of them alerts, some broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "sessionId", "group", "catalogVersion", "workspaceHash", "alertName")]
    + [T.StructField(n, T.LongType()) for n in ("turnNumber", "activeK", "fallbackTier", "routerEnumSize")]
    + [T.StructField(n, T.DoubleType()) for n in ("timestamp", "workspaceConfidence", "convConfidence", "alpha", "scorerLatencyMs")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("activeToolIds", "directToolCalls", "routerDescribes", "routerProxies")]
)
REQUIRED = ("sessionId", "turnNumber", "timestamp", "activeToolIds", "directToolCalls", "routerDescribes", "routerProxies")


def parsed(lines: DataFrame, *, keep_shadow: bool = False) -> DataFrame:
    """Events of text lines; blank and broken lines, alerts, lines without a required field and shadow events go."""
    e = lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null").select("e.*")
    whole: Column = F.coalesce(F.col("type") != "alert", F.lit(True))
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    if not keep_shadow:
        whole = whole & F.coalesce(F.col("group") != "shadow", F.lit(True))
    return e.where(whole).withColumn("ts", F.timestamp_millis((F.col("timestamp") * 1000).cast("long")))


def read_log(spark: SparkSession, path: str, *, since: float | None = None) -> DataFrame:
    found = parsed(spark.read.text(path))
    return found if since is None else found.where(F.col("timestamp") >= since)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come; the checkpoint of the query that uses it remembers which have been read."""
    return parsed(spark.readStream.text(folder))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
