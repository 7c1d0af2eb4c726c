"""Catalog reports (RPT1-RPT9).

Every report is a single aggregate; the partial (map-side) aggregation keeps
the shuffle at one row per group per task regardless of catalog size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.selection import with_local_paths
from corpusflow.schemas import REPO_STATUSES, status_dim

_GB = 1024 ** 3


def status_counts(catalog: DataFrame) -> DataFrame:
    """RPT1: count per status, zero-filled for all six states."""
    counts = catalog.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    dim = status_dim(catalog.sparkSession)
    return (F.broadcast(dim).join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def data_totals(catalog: DataFrame) -> DataFrame:
    """RPT2: rows, bytes and commits over downloaded + processed rows."""
    return (catalog.filter(F.col("status").isin("downloaded", "processed"))
            .agg(F.count(F.lit(1)).alias("total_repos_with_data"),
                 F.coalesce(F.sum("actual_size_bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
                 F.coalesce(F.sum("commit_count"), F.lit(0)).cast("bigint").alias("total_commits")))


def unique_languages(catalog: DataFrame, approx: bool = False) -> DataFrame:
    """RPT3: distinct non-null languages (exact, or HLL++ for huge catalogs)."""
    fn = F.approx_count_distinct if approx else F.countDistinct
    return catalog.agg(fn("language").alias("unique_languages"))


def language_distribution(catalog: DataFrame, top: int | None = 20) -> DataFrame:
    """RPT4: repositories per language, most frequent first."""
    df = (catalog.filter(F.col("language").isNotNull())
          .groupBy("language").agg(F.count(F.lit(1)).alias("n"))
          .orderBy(F.col("n").desc(), F.col("language")))
    return df.limit(top) if top else df


def _status_pivot(catalog: DataFrame) -> DataFrame:
    aggs = [F.count_if(F.col("status") == s).alias(s) for s in REPO_STATUSES]
    aggs.append(F.coalesce(F.sum(F.when(F.col("status").isin("downloaded", "processed"),
                                        F.col("actual_size_bytes"))), F.lit(0)).cast("bigint").alias("size_bytes"))
    aggs.append(F.coalesce(F.sum(F.when(F.col("status").isin("downloaded", "processed"),
                                        F.col("commit_count"))), F.lit(0)).cast("bigint").alias("commits"))
    return catalog.agg(*aggs)


def progress(catalog: DataFrame) -> DataFrame:
    """RPT5: crawl progress; the total leaves out ``processing`` (kept as is)."""
    p = _status_pivot(catalog)
    total = F.col("pending") + F.col("downloading") + F.col("downloaded") + F.col("processed") + F.col("failed")
    completed = F.col("downloaded") + F.col("processed")
    return p.select(
        total.alias("total_repos"), completed.alias("completed"), F.col("failed"), F.col("pending"),
        F.col("downloading").alias("in_progress"), F.col("processing"),
        F.round(F.coalesce(F.try_divide(completed * 100.0, F.nullif(total, F.lit(0))), F.lit(0.0)), 6)
        .alias("progress_percent"),
        F.round(F.col("size_bytes") / float(_GB), 6).alias("total_size_gb"),
        F.col("commits").alias("total_commits"),
    )


def repo_dirs(inventory: DataFrame, base_depth: int) -> DataFrame:
    """SRC4 aggregate: bytes per repository folder.

    ``inventory`` holds ``(path, length)`` rows, e.g. from
    :func:`corpusflow.sources.inventory.read_file_inventory`.  The repository
    folder is the path cut after ``base_depth + 2`` components (base/owner/name).
    """
    parts = F.split(F.col("path"), "/")
    repo_dir = F.array_join(F.slice(parts, 1, base_depth + 3), "/")
    return (inventory.filter(F.col("length").isNotNull())
            .groupBy(repo_dir.alias("repo_dir"))
            .agg(F.sum("length").cast("bigint").alias("size_bytes"),
                 F.count(F.lit(1)).alias("n_files")))


def reconcile_missing(catalog: DataFrame, dir_sizes: DataFrame) -> DataFrame:
    """RPT8 rows: catalog entries whose clone folder is absent become failed."""
    claimed = with_local_paths(catalog)
    missing = claimed.join(dir_sizes.select(F.col("repo_dir").alias("local_path")), "local_path", "left_anti")
    size_mb = F.bround(F.coalesce(F.col("size_kb"), F.lit(0)) / 1024.0, 0).cast("bigint")
    return missing.select(
        "full_name", F.col("status").alias("previous_status"), F.lit("failed").alias("status"),
        # fixed value: the text must match
        F.format_string("reconciled: local directory missing (was %s, ~%d MB)", F.col("status"), size_mb)
        .alias("last_error"))


def reconcile_summary(catalog: DataFrame, dir_sizes: DataFrame) -> DataFrame:
    """RPT8 counts: checked / missing / ok."""
    claimed = with_local_paths(catalog)
    flagged = claimed.join(
        dir_sizes.select(F.col("repo_dir").alias("local_path"), F.lit(True).alias("present")),
        "local_path", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("present").isNull()).alias("missing"),
        F.count_if(F.col("present")).alias("ok"))


def oversize(dir_sizes: DataFrame, limit_bytes: int = 2 * _GB) -> DataFrame:
    """RPT9: folders over the size limit, largest first (report only)."""
    return (dir_sizes.filter(F.col("size_bytes") > limit_bytes)
            .select("repo_dir", "size_bytes", F.round(F.col("size_bytes") / float(_GB), 3).alias("size_gb"))
            .orderBy(F.col("size_bytes").desc(), "repo_dir"))


def oversize_total(dir_sizes: DataFrame, limit_bytes: int = 2 * _GB) -> DataFrame:
    """RPT9 total: how many folders and bytes a clean-up would free."""
    big = dir_sizes.filter(F.col("size_bytes") > limit_bytes)
    return big.agg(F.count(F.lit(1)).alias("n_repos"),
                   F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes_freed"))
