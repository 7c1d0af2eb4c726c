"""Batches of renames (CAT13): chains, swaps and redirects, decided for the whole batch at once.

Every row takes its own new name; a name is free for it if nobody has it, or if the row
that has it moves away in the same batch.  So ``a -> b -> c`` moves both rows, ``a -> b, b -> a``
swaps them, and a row whose chain ends at a row that stays is refused, as is everyone
behind it.  A name that is no row is only passed through: with ``a -> b, b -> c`` and no row
``b`` the row ``a`` becomes ``c``.  Of several rows that want one name the least
name gets it.

Chains are followed by pointer doubling over the table of renames alone: ``log2`` of the
longest chain joins.  Every join brings the next pointers of an open chain to its end, so
when a join ends none, what is open runs in a circle.  Each join's result is a table in the
checkpoint folder: read again it has the size of its files, while a checkpointed join keeps the
planner's estimate, the product of both sides, and that number's digits double with every join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir


def _kept(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/renames-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _follow(pointers: DataFrame) -> DataFrame:
    """``x, to, done`` with every open pointer followed to its end; what stays open is a circle."""
    left, before = pointers.where("not done").count(), None
    while left and left != before:
        ahead = pointers.select(F.col("x").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        pointers = _kept(pointers.join(ahead, "to", "left").select(
            "x", F.when(~F.col("done"), F.coalesce("_to", "to")).otherwise(F.col("to")).alias("to"),
            (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")))
        left, before = pointers.where("not done").count(), left
    return pointers


def resolve(names: DataFrame, renames: DataFrame) -> DataFrame:
    """``old_name, new_name, refused`` of every row of ``names`` (``full_name``, distinct) that ``renames``
    (``old_name, new_name``) want to move."""
    wanted = renames.where("old_name <> new_name").groupBy("old_name").agg(F.min("new_name").alias("new_name"))
    row = names.select(F.col("full_name").alias("_n"), F.lit(True).alias("_row")).distinct()
    asked = wanted.select(F.col("old_name").alias("_n"), F.lit(True).alias("_asked"))
    wanted = wanted.join(row.withColumnRenamed("_n", "new_name"), "new_name", "left").join(asked.withColumnRenamed("_n", "new_name"), "new_name", "left")
    # a pointer ends at a row, or at a name that nothing renames
    pointers = _kept(wanted.select(F.col("old_name").alias("x"), F.col("new_name").alias("to"),
                                   (F.col("_row").isNotNull() | F.col("_asked").isNull()).alias("done")))
    ends = _follow(pointers)
    moves = ends.join(row.select(F.col("_n").alias("x")), "x", "left_semi")
    first = moves.where("done").groupBy("to").agg(F.min("x").alias("_first"))
    moves = moves.join(first, "to", "left").select(
        F.col("x"), F.col("to"), (~F.col("done") | (F.col("x") != F.col("_first")) | (F.col("x") == F.col("to"))).alias("lost"))
    moves = _kept(moves)
    # a mover ends well where the name is free, badly where a row stays; else it depends on that row
    mover = moves.where("not lost").select(F.col("x").alias("_n"), F.lit(True).alias("_moves"))
    chain = moves.where("not lost").join(row.withColumnRenamed("_n", "to"), "to", "left").join(mover.withColumnRenamed("_n", "to"), "to", "left")
    state = _kept(chain.select("x", "to", F.col("_row").isNotNull().alias("taken"), (F.col("_moves").isNull()).alias("done")))
    last = _follow(state.select("x", "to", "done"))
    # ``to`` is now the last name of the chain: taken by a row that stays, or free, or the chain is a circle
    good = last.join(row.withColumnRenamed("_n", "to"), "to", "left").where(~F.col("done") | F.col("_row").isNull()).select("x", F.lit(True).alias("_good"))
    return moves.join(good, "x", "left").select(
        F.col("x").alias("old_name"), F.col("to").alias("new_name"), (F.col("lost") | F.col("_good").isNull()).alias("refused"))
