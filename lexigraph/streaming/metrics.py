"""The event metrics as streams. Each takes a streaming (or batch) table and gives one; late events are kept for the watermark, which
the batch log had no notion of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir


def sliding(events: DataFrame, *, ts: str = "ts", late: str = "10 minutes", size: str = "30 minutes", slide: str = "1 minute", by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by..., start, end, events, describe_rate, tier56_rate, mean_latency) of every window, by event time."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    n = F.count("*")
    out = timed.groupBy(F.window("__ts", size, slide).alias("w"), *by).agg(
        n.alias("events"), (F.count_if(F.size("describes") > 0) / n).alias("describe_rate"), (F.count_if(F.col("tier") >= 5) / n).alias("tier56_rate"), F.avg("latency").alias("mean_latency")
    )
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "describe_rate", "tier56_rate", "mean_latency")


def sessions(events: DataFrame, by: tuple[str, ...], *, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.session_window("__ts", gap).alias("w"), *by).agg(F.count("*").alias("events"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_once(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the stream, into a table in the shared folder; the table."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{top}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")
