"""Work-list selection over the repository catalog (SEL1-SEL7).

All selections are filters plus an ordered ``limit``; Spark plans those as
TakeOrderedAndProject (per-partition top-k, then a k-row merge), so no
global sort of the catalog happens.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _meta_with_defaults(df: DataFrame) -> DataFrame:
    """RepoMetadata view of catalog rows; NULLs (or absent columns) take
    the defaults: size 0, branch ``main``, fork/archived false."""
    def c(name, typ):
        return F.col(name) if name in df.columns else F.lit(None).cast(typ)
    return df.select(
        "full_name", c("stars", "int").alias("stars"), c("language", "string").alias("language"),
        c("license_key", "string").alias("license_key"),
        F.coalesce(c("size_kb", "bigint"), F.lit(0).cast("bigint")).alias("size_kb"),
        F.coalesce(c("default_branch", "string"), F.lit("main")).alias("default_branch"),
        F.coalesce(c("fork", "boolean"), F.lit(False)).alias("fork"),
        F.coalesce(c("archived", "boolean"), F.lit(False)).alias("archived"),
    )


def size_ok(max_size_kb: int | None) -> Column:
    """Size filter; off when the limit is 0/None, unknown sizes always pass."""
    if not max_size_kb:
        return F.lit(True)
    return F.col("size_kb").isNull() | (F.col("size_kb") <= F.lit(max_size_kb))


def hash_order(seed: int | str, *cols: str) -> Column:
    """Reproducible pseudo-random order key (same on every task retry)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def pending_batch(catalog: DataFrame, batch_size: int = 100, max_size_kb: int | None = None,
                  randomize: bool = False, seed: int = 0) -> DataFrame:
    """SEL1/SEL2: next repositories to download."""
    df = catalog.filter((F.col("status") == "pending") & size_ok(max_size_kb))
    if randomize:
        order = [hash_order(seed, "full_name"), F.col("full_name")]
    else:
        order = [F.col("stars").desc_nulls_last(), F.col("full_name")]
    return _meta_with_defaults(df.orderBy(*order).limit(batch_size))


def downloaded_page(catalog: DataFrame, batch_size: int = 100, offset: int = 0) -> DataFrame:
    """SEL3: downloaded repositories, paged by stars."""
    return (catalog.filter(F.col("status") == "downloaded")
            .orderBy(F.col("stars").desc_nulls_last(), F.col("full_name"))
            .offset(offset).limit(batch_size)
            .select("full_name", "local_path", "language"))


def downloaded_after(catalog: DataFrame, stars: int | None, full_name: str, batch_size: int = 100) -> DataFrame:
    """SEL3 by key: the page behind the row ``(stars, full_name)``.  Rows before it are
    filtered in the scan, so a late page costs what the first one does and each task
    keeps ``batch_size`` rows.  Rows without stars come last, ordered by name."""
    later = F.col("stars").isNull() & (F.col("full_name") > full_name)
    if stars is not None:
        later = (F.col("stars") < stars) | ((F.col("stars") == stars) & (F.col("full_name") > full_name)) | F.col("stars").isNull()
    return downloaded_page(catalog.filter(later), batch_size).select("full_name", "local_path", "language")


def with_local_paths(catalog: DataFrame) -> DataFrame:
    """SEL4: rows that claim a local clone."""
    return (catalog.filter(F.col("status").isin("downloaded", "processed") & F.col("local_path").isNotNull())
            .select("full_name", "local_path", "status", "size_kb"))


def stale(catalog: DataFrame, now: _dt.date, max_age_days: int = 30, limit: int = 1000,
          updated_col: str = "metadata_updated_on") -> DataFrame:
    """SEL5: never refreshed, or refreshed before ``now - max_age_days``."""
    cutoff = F.date_sub(F.lit(now), max_age_days)
    return (catalog.filter(F.col(updated_col).isNull() | (F.col(updated_col) < cutoff))
            .orderBy(F.col("stars").desc_nulls_last(), F.col("full_name")).limit(limit)
            .select("full_name", "stars"))


def queue_count(catalog: DataFrame, limit: int = 1000, min_stars: int = 0) -> DataFrame:
    """SEL6: pending rows over a star floor, capped at ``limit``."""
    return (catalog.filter((F.col("status") == "pending") & (F.col("stars") >= min_stars))
            .agg(F.least(F.count(F.lit(1)), F.lit(limit).cast("bigint")).alias("queued")))


def count_by_status(catalog: DataFrame, status: str) -> DataFrame:
    """SEL7."""
    return catalog.filter(F.col("status") == status).agg(F.count(F.lit(1)).alias("n"))
