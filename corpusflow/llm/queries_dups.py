"""Registered queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import neardup, runindex
from corpusflow.llm.common import table
from corpusflow.llm.registry import query


@query("op8_minhash_neardup")
def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy component of every document (three words, 0.85)."""
    return neardup.link_documents(table(spark, sf_dir, "documents"), width=3, threshold=0.85).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op1_run_index_dedup")
def op1_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by a 400-byte string that starts twice."""
    return runindex.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
