"""Token counts through a cache keyed by digests.

A text is known by the SHA-256 of its normalised content (null becomes the
empty string; nothing else may change, since byte-level BPE counts depend on
every byte) and a tokenizer by the SHA-256 of its file.  Counts live in a
Parquet table ``(version, digest, n_tokens)``.  A run reduces the documents to
one row for each digest, drops those the cache has, encodes the rest once each,
appends them, and joins the counts to the documents.

Only digests are joined; texts are shuffled once, reduced to one for each digest
on the map side.  A group of copies is one row of that reduction, and the join
back has one cache row for each digest, so AQE may split the documents of a hot
digest.  The appended files appear when the write commits; a lost task is run
again.  Two runs at the same time may append a digest twice with equal counts,
which the read collapses.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
all returned; other columns are ignored; an empty table gives no rows and
appends none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.encoding import counter, sliced

CACHE = "version string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def encode_misses(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``(digest, text)`` to ``(digest, n_tokens)``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for b in batches:
            # a few texts of a batch are Python objects at a time
            n = [x for part in sliced(b.column("text")) for x in known.counts(part)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(encode, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; the cache grows by the misses."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2("text", 256)).alias("digest"))
    known = read_cache(spark, cache).where(F.col("version") == version).select("digest")
    missing = own.select("digest", "text").join(known, "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.any_value("text").alias("text"))
    (encode_misses(distinct, tokenizer)
     .select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache))
    counts = (read_cache(spark, cache).where(F.col("version") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return own.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
