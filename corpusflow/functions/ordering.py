"""Skew-safe sequence numbers.

``row_number()`` over ``Window.partitionBy(key)`` sorts every row of a key
inside one task; a key holding a third of the data then runs on one core.
:func:`seq_number` gives the same numbers without that: rows are range
partitioned on ``(keys, order)`` so a hot key spans many tasks, each task
numbers its rows locally (``monotonically_increasing_id`` after a local
sort), and a small per-(partition, key) count table supplies the offset of
every key run.  Only the count table (one row per key and partition) is
aggregated; the data itself is shuffled once by range and once by the
(partition, key) join.  The order must be total (add a unique tie-breaker).

The range bounds come from sampling, so two evaluations of the ranged data
could cut partitions differently; the ranged, locally numbered rows are
therefore checkpointed once (reliable checkpoint in the cluster's
``spark.checkpoint.dir``) and both the counts and the join read that copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir


def _ranged(df: DataFrame, keys: list[str], order: list[Column], n_parts: int | None) -> DataFrame:
    """Rows in range partitions of ``(keys, order)`` with ``_pid`` and ``_idx``, checkpointed."""
    spark = df.sparkSession
    key_cols = [F.col(k) for k in keys]
    # without a given number the count follows the data (AQE merges small ranges)
    dealt = df.repartitionByRange(n_parts, *key_cols, *order) if n_parts else df.repartitionByRange(*key_cols, *order)
    ranged = (dealt.sortWithinPartitions(*key_cols, *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_idx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    checkpoint_dir(spark)
    return ranged.checkpoint(eager=True)


def seq_number(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn",
               n_parts: int | None = None) -> DataFrame:
    ranged = _ranged(df, keys, order, n_parts)
    runs = ranged.groupBy("_pid", *keys).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (ranged.join(runs.select("_pid", *keys, "_first", "_off"), ["_pid", *keys])
            .withColumn(name, F.col("_idx") - F.col("_first") + F.col("_off") + 1)
            .drop("_pid", "_idx", "_first", "_off"))


def seq_since(df: DataFrame, keys: list[str], order: list[Column], mark: Column, name: str,
              n_parts: int | None = None) -> DataFrame:
    """Number rows of a key from 1, anew after every row that ``mark`` holds for.

    Built like :func:`seq_number`: each task numbers its own stretch of a key,
    and one row per (partition, key) carries the last mark into the next."""
    ranged = _ranged(df.withColumn("_mark", F.coalesce(mark, F.lit(False))), keys, order, n_parts)
    runs = ranged.groupBy("_pid", *keys).agg(
        F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_mark"), F.col("_idx"))).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    runs = runs.withColumn("_carried", F.coalesce(
        F.max(F.col("_last") - F.col("_first") + F.col("_off") + 1).over(w), F.lit(0)))
    rn = F.col("_idx") - F.col("_first") + F.col("_off") + 1
    inside = Window.partitionBy("_pid", *keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(runs.select("_pid", *keys, "_first", "_off", "_carried"), ["_pid", *keys])
            .withColumn("_rn", rn)
            .withColumn(name, F.col("_rn") - F.coalesce(F.max(F.when(F.col("_mark"), F.col("_rn"))).over(inside), F.col("_carried")))
            .drop("_pid", "_idx", "_first", "_off", "_carried", "_mark", "_rn"))
