"""File sources: listings, contents, media, trees. Lists come from Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_indexable, matches_glob, mime_type


def listing(spark: SparkSession, root: str, *, glob: str | None = None) -> DataFrame:
    """(path, name, modified, size, relative): files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    where = root.split("://")[-1].rstrip("/")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.regexp_replace("path", f"^.*?{where}/", "").alias("relative"))


def found(spark: SparkSession, root: str, *, name: str | None = None, contains: str | None = None, exclude: tuple[str, ...] = (), most: int = 100) -> DataFrame:
    files = listing(spark, root)
    if name:
        files = files.where(matches_glob(F.col("name"), name))
    if contains:
        files = files.where(F.contains(F.lower("relative"), F.lit(contains.lower())))
    for pattern in exclude:
        files = files.where(~matches_glob(F.col("relative"), pattern))
    return files.orderBy("relative").limit(most)


def indexable(spark: SparkSession, root: str, *, most: int = 5000) -> DataFrame:
    return listing(spark, root).where(is_indexable(F.col("relative"), F.col("size"))).orderBy("relative").limit(most)


def contents(spark: SparkSession, root: str, *, glob: str | None = None) -> DataFrame:
    """(path, text): whole files; what isn't UTF-8 is replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def media(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, mime, data): contents in base64."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", mime_type(F.col("path")).alias("mime"), F.base64("content").alias("data"))


def tree(files: DataFrame, *, depth: int = 10, per_folder: int = 250, most: int = 500) -> DataFrame:
    """(parent, name, is_folder, files, size): what a folder holds, folders first, then by name with numbers by value."""
    parts = F.split("relative", "/")
    ups = files.select("size", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), F.get(parts, n - 1).alias("name"), (n < F.size(parts)).alias("is_folder")))).alias("x"))
    rows = ups.groupBy("x.parent", "x.name", "x.is_folder").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    key = F.regexp_replace(F.regexp_replace(F.lower("name"), r"(\d+)", "0000000000$1"), r"0*(\d{10})", "$1")
    order = Window.partitionBy("parent").orderBy(F.desc("is_folder"), key, "name")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_folder).orderBy("parent", "position").limit(most)


def read_many(spark: SparkSession, paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text, error): a row for each asked path (at most 50 are asked at once); what isn't there is an error, no failure."""
    joined = paths.limit(50).join(files.select("path", "text"), "path", "left")
    return joined.withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no such file: "), "path")))
