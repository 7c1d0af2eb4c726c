"""Registered queries of the archive and toxicity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import toxicity, warc
from corpusflow.llm.common import table
from corpusflow.llm.registry import query

THRESHOLD = 0.3


@query("op5_warc_archives")
def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as Zstandard WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(doc_id: Column) -> Column:
    """Rows that may be scored but never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the rows not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
