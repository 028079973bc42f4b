"""What the training-data operators share: shared storage, readers and byte-level text rules."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir

#: The white space that every contract names, `[\x20\x09-\x0D]`, as bytes.
SPACE = b" \t\n\x0b\x0c\r"
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, level: int = 3) -> DataFrame:
    """`df` as a written table in the shared folder, so that a lost executor costs a read, not a recomputation.

    The table stays for the session, as lazy results may still read it, and goes at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigraph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one if the table has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with two columns more, that together are a row's own, and their names. Ids may be null or repeated; what is decided of a
    row is decided by these. A table read straight from files has the file's hash and the row's place in it; anything else is written
    first, as a second run of its plan may give other rows."""
    file, line = free_name(docs, "row_file"), free_name(docs, "row_line")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(line)), file, line
        except AnalysisException:  # not a format that counts its rows
            pass
    return materialise(docs.withColumn(file, F.lit(0).cast("long")).withColumn(line, F.monotonically_increasing_id())), file, line


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str, str]:
    """The columns an operator reads with what tells rows apart, (doc_id, row_file, row_line, text), and what `numbered` gives."""
    docs, file, line = numbered(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(file).alias("row_file"), F.col(line).alias("row_line"), F.col(text_col).cast("string").alias("text"))
    return slim, docs, file, line


def without(docs: DataFrame, gone: DataFrame, file: str, line: str) -> DataFrame:
    """The rows of `docs` (as `numbered` gives them) that aren't in `gone` (row_file, row_line)."""
    gone = materialise(gone.select(F.col("row_file").alias(f"{file}_gone"), F.col("row_line").alias(f"{line}_gone")))
    return docs.join(gone, (docs[file] == gone[f"{file}_gone"]) & (docs[line] == gone[f"{line}_gone"]), "left_anti").drop(file, line)


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`kernel`, after which the worker gives its free memory back to the system: workers live on from one stage to the next, beside
    those of that stage and the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash with its own names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
