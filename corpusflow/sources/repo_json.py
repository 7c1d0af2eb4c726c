"""SRC1/SRC2: raw repository JSON -> typed catalog rows; catalog paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.schemas import RAW_REPO


def _iso_ts(c):
    # API timestamps end in 'Z'; treat it as +00:00 (session zone is UTC).
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def parse_repo_json(df: DataFrame, col: str = "value") -> DataFrame:
    """SRC1: parse JSON text with an explicit schema and apply the defaults:
    size 0, branch ``main``, fork/archived false, license from ``license.key``."""
    j = df.withColumn("_j", F.from_json(F.col(col), RAW_REPO))
    keep = [c for c in df.columns if c != col]
    return j.select(
        *keep,
        F.col("_j.id").alias("id"),
        F.col("_j.full_name").alias("full_name"),
        F.coalesce(F.col("_j.stargazers_count"), F.lit(0)).alias("stars"),
        F.col("_j.language").alias("language"),
        F.col("_j.license.key").alias("license_key"),
        F.coalesce(F.col("_j.size"), F.lit(0).cast("bigint")).alias("size_kb"),
        F.coalesce(F.col("_j.default_branch"), F.lit("main")).alias("default_branch"),
        F.coalesce(F.col("_j.fork"), F.lit(False)).alias("fork"),
        F.coalesce(F.col("_j.archived"), F.lit(False)).alias("archived"),
        _iso_ts(F.col("_j.created_at")).alias("created_at"),
        _iso_ts(F.col("_j.updated_at")).alias("updated_at"),
    )


def read_repo_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 for files: JSON lines, one raw repository per line."""
    return parse_repo_json(spark.read.text(path))


def repo_paths(catalog: DataFrame, repos_base: str, status: str = "downloaded") -> DataFrame:
    """SRC2: catalog rows of one status with their clone folder."""
    rebuilt = F.concat_ws("/", F.lit(repos_base.rstrip("/")), F.col("owner"), F.col("name"))
    return (catalog.filter(F.col("status") == status)
            .select("full_name", "language", F.coalesce(F.col("local_path"), rebuilt).alias("repo_path")))
