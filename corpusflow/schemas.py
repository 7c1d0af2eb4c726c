"""Schemas and small fixed dimensions shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The six repository states, in lifecycle order.
REPO_STATUSES = ("pending", "downloading", "downloaded", "processing", "processed", "failed")

# Failure actions of the download classifier.
FAILURE_ACTIONS = ("retry", "retry_later", "retry_extended", "skip")

REPO_META = T.StructType([
    T.StructField("full_name", T.StringType(), False),
    T.StructField("stars", T.IntegerType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("license_key", T.StringType(), True),
    T.StructField("size_kb", T.LongType(), True),
    T.StructField("default_branch", T.StringType(), True),
    T.StructField("fork", T.BooleanType(), True),
    T.StructField("archived", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

# Raw search-API record (only the fields the catalog keeps).
RAW_REPO = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("full_name", T.StringType(), True),
    T.StructField("stargazers_count", T.IntegerType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("license", T.StructType([T.StructField("key", T.StringType(), True)]), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("default_branch", T.StringType(), True),
    T.StructField("fork", T.BooleanType(), True),
    T.StructField("archived", T.BooleanType(), True),
    T.StructField("created_at", T.StringType(), True),
    T.StructField("updated_at", T.StringType(), True),
])

BAND_PROGRESS = T.StructType([
    T.StructField("tier", T.StringType(), False),
    T.StructField("language", T.StringType(), False),
    T.StructField("star_range_low", T.IntegerType(), False),
    T.StructField("star_range_high", T.IntegerType(), True),
    T.StructField("repos_found", T.LongType(), True),
])


def status_dim(spark: SparkSession) -> DataFrame:
    """Six-row status dimension (tiny, fixed size: safe to broadcast)."""
    return spark.createDataFrame(
        [(s, i) for i, s in enumerate(REPO_STATUSES)], "status string, status_ord int")
