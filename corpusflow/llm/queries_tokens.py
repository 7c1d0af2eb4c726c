"""Registered queries of the tokenizer operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import token_counts, token_files
from corpusflow.llm.common import shared_path, table
from corpusflow.llm.registry import query

TOKEN_LIMIT = 512


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache that begins empty."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "token-counts"),
                                       public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as grammar-compressed token files and read back."""
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
