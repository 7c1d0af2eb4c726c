"""SNK1: snapshots of keyed tables, as partitions of one Parquet table.

A snapshot is the partition ``version=<n>`` and is written by Spark's dynamic partition
overwrite: its files appear when the job commits, so a reader never meets half a
snapshot, a job never overwrites what it reads, and writing a version again replaces
that version alone.  One writer at a time.  A snapshot without rows leaves no
partition: the latest version is the last one with rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_versions(spark: SparkSession, root: str) -> DataFrame | None:
    """All snapshots with their ``version``; None before the first one."""
    try:
        return spark.read.parquet(root)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current_version(spark: SparkSession, root: str) -> int | None:
    held = read_versions(spark, root)
    return None if held is None else held.agg(F.max("version")).first()[0]


def write_snapshot(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), sort_within: tuple[str, ...] = (),
                   version: int | None = None) -> int:
    """Writes the next version, or ``version`` anew; all versions of a table share ``partition_by``."""
    if version is None:
        latest = current_version(df.sparkSession, root)
        version = 0 if latest is None else latest + 1
    folders = ("version", *partition_by)
    out = df.withColumn("version", F.lit(version))
    if sort_within:
        out = out.sortWithinPartitions(*folders, *sort_within)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(root)
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, root) if version is None else version
    held = read_versions(spark, root)
    if v is None or held is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return held.where(F.col("version") == v).drop("version")
