"""Corpus pipeline: quality rules, near copies, benchmark leaks, source mix, token files.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over everything
its predecessor kept; its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import leaks, mixing, neardup, quality, token_files
from corpusflow.llm.common import keep, table

# targets of the mixture
MIN_ENTROPY = 0.95
MAX_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; the others go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    return neardup.keep_one(docs, width=5, threshold=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; the others go."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: as many tokens as came in, dealt by the sources' weights."""
    return mixing.mix(docs, min_entropy=MIN_ENTROPY, max_repeats=MAX_REPEATS).select(
        *[f"`{c}`" for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: one row for each document in them."""
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The token stage has no SQL form; tests hold run() against brute force.
ORACLE_SQL = None
