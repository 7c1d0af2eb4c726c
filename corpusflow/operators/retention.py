"""Token retention at a budget (EVL9): which answer tokens are among the ``M`` heaviest.

Up to Spark's limit for ranks in a group (``windowGroupLimitThreshold``), a map task
ranks its own tokens and at most ``M`` of a query leave it, so neither a token's row nor a
histogram is joined.

For greater budgets the cut of the ``M`` heaviest tokens of a query is found without sorting them: a
histogram of weights (one row for each query and bin, combined before the shuffle)
names the bin in which the ``M``-th token lies.  Tokens of heavier bins are kept as they
are counted; only tokens of the cut bin are ranked, and of those at most ``M`` of a
query leave a map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def retained(tokens: DataFrame, budgets: list[int], keys: list[str], weight: str = "weight", answer: str = "is_answer",
             tie: str = "pos", bins: int = BINS) -> DataFrame:
    """``keys, budget, answer_tokens, kept`` of every query: how many answer tokens are among
    the ``budget`` heaviest tokens (ties: smaller ``tie``)."""
    limit = int(tokens.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if max(budgets) <= limit:
        return _ranked(tokens, budgets, keys, weight, answer, tie)
    return _binned(tokens, budgets, keys, weight, answer, tie, bins)


def _ranked(tokens: DataFrame, budgets: list[int], keys: list[str], weight: str, answer: str, tie: str) -> DataFrame:
    """:func:`retained` by the ranks of each query's ``max(budgets)`` heaviest tokens."""
    tokens = tokens.dropna(subset=keys)
    first = Window.partitionBy(*keys).orderBy(F.desc(weight), tie)
    top = tokens.select(*keys, weight, tie, answer).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= max(budgets))
    kept = top.groupBy(*keys).agg(*[F.count_if(F.col(answer) & (F.col("_rank") <= m)).alias(f"_k{m}") for m in budgets])
    total = tokens.groupBy(*keys).agg(F.count_if(answer).alias("answer_tokens"))
    per = F.inline(F.array(*[F.struct(F.lit(m).alias("budget"), F.col("answer_tokens"), F.col(f"_k{m}").alias("kept")) for m in budgets]))
    return total.join(kept, keys).select(*keys, per)


def _binned(tokens: DataFrame, budgets: list[int], keys: list[str], weight: str, answer: str, tie: str, bins: int) -> DataFrame:
    """:func:`retained` by a histogram of each query's weights."""
    ends = tokens.groupBy(*keys).agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))
    share = (F.col(weight) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = tokens.join(ends, keys).select(*keys, weight, tie, answer, at.alias("_bin"))
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.count_if(answer).alias("_a"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
    hist = hist.withColumns({"_before": F.coalesce(F.sum("_n").over(above), F.lit(0)), "_kept": F.coalesce(F.sum("_a").over(above), F.lit(0))})
    budget = F.explode(F.array(*[F.lit(m) for m in budgets])).alias("budget")
    per = hist.select(*keys, "_bin", "_n", "_a", "_before", "_kept", budget)
    # whole bins of the budget, and the bin it ends in
    cut = per.where((F.col("_before") < F.col("budget")) & (F.col("_before") + F.col("_n") > F.col("budget"))).select(
        *keys, "_bin", "budget", (F.col("budget") - F.col("_before")).alias("_room"))
    whole = per.where(F.col("_before") + F.col("_n") <= F.col("budget")).groupBy(*keys, "budget").agg(F.sum("_a").alias("_whole"))
    first = Window.partitionBy(*keys, "budget").orderBy(F.desc(weight), tie)
    inside = (binned.join(cut, [*keys, "_bin"]).withColumn("_rank", F.row_number().over(first))
              .where(F.col("_rank") <= max(budgets)).where(F.col("_rank") <= F.col("_room"))
              .groupBy(*keys, "budget").agg(F.count_if(answer).alias("_in")))
    total = hist.groupBy(*keys).agg(F.sum("_a").alias("answer_tokens")).select(*keys, "answer_tokens", budget)
    return (total.join(whole, [*keys, "budget"], "left").join(inside, [*keys, "budget"], "left")
            .select(*keys, "budget", "answer_tokens", (F.coalesce("_whole", F.lit(0)) + F.coalesce("_in", F.lit(0))).alias("kept")))


def retention(tokens: DataFrame, budgets: list[int], keys: list[str], **more) -> DataFrame:
    """EVL9: ``budget, queries, answer_tokens, kept, share`` over all queries with an answer token."""
    per = retained(tokens, budgets, keys, **more).where("answer_tokens > 0")
    return per.groupBy("budget").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("answer_tokens").alias("answer_tokens"), F.sum("kept").alias("kept")).withColumn(
        "share", F.col("kept") / F.col("answer_tokens"))
