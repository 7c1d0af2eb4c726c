"""Distinct counts that roll up (RPT3): one mergeable sketch for each snapshot or day.

Sketches are stored beside what they were built from and merged by any coarser
key without reading that again.  HyperLogLog sketches of ``2**LG_K`` registers have a
relative standard error of about ``1.04 / sqrt(2**LG_K)`` (0.8 % at 14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, by: list[Column], value: str, lg_k: int = LG_K) -> DataFrame:
    """A row for each ``by`` with the sketch of the distinct non-null values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def rolled_up(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """Sketches merged by a coarser key, with their estimate."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn(
        "estimate", F.hll_sketch_estimate("sketch"))
