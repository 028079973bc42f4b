"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it. Only where everything runs in one process, as
    in tests, is a local one made if none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage of iterations, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
