"""A corpus from raw documents to tokens: toxic documents go, of equal texts one stays, of similar texts one stays, sources are mixed
to target weights, and what is left is encoded.

Each stage reads what the one before has written. All but the last return the columns of `documents`: doc_id, text, lang, source,
n_chars. Nulls, empty texts and empty tables go through as the operators say; the mix drops documents that it takes no words of and
repeats a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.exact_dedup import drop_copies
from lexigraph.llm.mixing import mixed_documents
from lexigraph.llm.pieces import round_trip
from lexigraph.llm.simhash import keep_one
from lexigraph.llm.toxicity import keep_clean


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return round_trip(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_equal),
    ("SimHash near-dedup", drop_similar),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]
#: A trained classifier, similarity estimates and a vocabulary can't be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
