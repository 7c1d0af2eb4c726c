"""Evaluation of generated answers (EVL1-EVL9, SNK2, UDX5).

Predictions arrive as a table ``(example_id, category, variant, expected,
generated)`` from any model.  All metrics are aggregates; overall and
per-category accuracy come from one ROLLUP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """EVL1: strip surrounding whitespace, lower-case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def exact_match(generated: Column, expected: Column) -> Column:
    """EVL1: equal, or the generation starts with the expected answer (an
    empty expected answer therefore always matches; kept)."""
    return (generated == expected) | generated.startswith(expected)


def word_match(generated: Column, expected: Column) -> Column:
    """EVL2: expected occurs as a whole word (Unicode word characters);
    empty expected never matches."""
    quoted = F.concat(F.lit("\\Q"), F.replace(expected, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("(?U)(?<!\\w)"), quoted, F.lit("(?!\\w)"))
    return (F.length(expected) > 0) & F.regexp_like(generated, pattern)


def score(preds: DataFrame) -> DataFrame:
    """EVL1 + EVL2 per row, plus strict equality as a second exact column."""
    g, e = normalize(F.col("generated")), normalize(F.col("expected"))
    return preds.withColumn("_g", g).withColumn("_e", e).select(
        "*", exact_match(F.col("_g"), F.col("_e")).alias("exact"),
        (F.col("_g") == F.col("_e")).alias("strict"),
        F.coalesce(word_match(F.col("_g"), F.col("_e")), F.lit(False)).alias("substring")).drop("_g", "_e")


def accuracy(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL3 + EVL4: overall (``category`` NULL) and per-category accuracy in
    one ROLLUP; 0 when there are no rows."""
    keys = (by or []) + ["category"]
    agg = [F.count(F.lit(1)).alias("total"),
           F.coalesce(F.avg(F.col("exact").cast("double")), F.lit(0.0)).alias("exact_acc"),
           F.coalesce(F.avg(F.col("substring").cast("double")), F.lit(0.0)).alias("substring_acc"),
           F.coalesce(F.avg(F.col("strict").cast("double")), F.lit(0.0)).alias("strict_acc")]
    if by:
        return scored.rollup(*keys).agg(*agg).filter(F.col(by[0]).isNotNull())
    return scored.rollup("category").agg(*agg)


def evaluate(preds: DataFrame, evaluation: Callable[[DataFrame], DataFrame] | None = None,
             by: list[str] | None = None) -> DataFrame:
    """UDX5: the caller's evaluation of a prediction table; by default the
    accuracy of the scored rows.  ``evaluation`` gets the scored rows and
    returns any aggregate of them, planned by Spark like the rest."""
    scored = score(preds)
    return accuracy(scored, by) if evaluation is None else evaluation(scored)


def first_failures(scored: DataFrame, n: int = 3, by: list[str] | None = None) -> DataFrame:
    """EVL5: the first ``n`` non-exact rows per category (by example id)."""
    part = (by or []) + ["category"]
    w = Window.partitionBy(*part).orderBy("example_id")
    return scored.filter(~F.col("exact")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def memory_delta(acc: DataFrame, with_v: str = "with_memory", without_v: str = "without_memory") -> DataFrame:
    """EVL6: with - without memory, overall and per category; a category
    missing from one run counts as 0 there."""
    a = acc.filter(F.col("variant") == with_v).select(
        F.coalesce("category", F.lit("__all__")).alias("_k"), "category",
        F.col("exact_acc").alias("with_exact"), F.col("substring_acc").alias("with_substring"))
    b = acc.filter(F.col("variant") == without_v).select(
        F.coalesce("category", F.lit("__all__")).alias("_k"), F.col("category").alias("_c2"),
        F.col("exact_acc").alias("without_exact"), F.col("substring_acc").alias("without_substring"))
    j = a.join(b, "_k", "full_outer")
    return j.select(
        F.coalesce("category", "_c2").alias("category"),
        (F.coalesce("with_exact", F.lit(0.0)) - F.coalesce("without_exact", F.lit(0.0))).alias("exact_delta"),
        (F.coalesce("with_substring", F.lit(0.0)) - F.coalesce("without_substring", F.lit(0.0)))
        .alias("substring_delta"))


def paired_delta(scored: DataFrame, with_v: str = "with_memory", without_v: str = "without_memory") -> DataFrame:
    """EVL6 (paired): the two runs joined on ``example_id``: per category,
    examples fixed / broken by memory among examples scored in both runs."""
    a = scored.filter(F.col("variant") == with_v).select("example_id", "category", F.col("exact").alias("w"))
    b = scored.filter(F.col("variant") == without_v).select("example_id", F.col("exact").alias("wo"))
    j = a.join(b, "example_id")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("paired"),
                                     F.count_if(F.col("w") & ~F.col("wo")).alias("fixed"),
                                     F.count_if(~F.col("w") & F.col("wo")).alias("broken"))


def verdict(accuracy_col: Column, avg_gate: Column) -> Column:
    """EVL7: success / partial / investigate."""
    return (F.when((accuracy_col > 0.5) & (F.abs(avg_gate) > 0.1), "success")
            .when((accuracy_col > 0.1) | (F.abs(avg_gate) > 0.05), "partial")
            .otherwise("investigate"))


def edit_similarity(a: Column, b: Column) -> Column:
    """EVL8: ``1 - levenshtein / max(length)`` (1 for two empty strings)."""
    mx = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / mx)  # equal texts need no table


def hit_rates(ranks: DataFrame, ks: list[int], rank_col: str = "needle_rank", by: list[str] | None = None
              ) -> DataFrame:
    """EVL9: share of queries whose needle is within rank k, for each k."""
    aggs = [F.avg(F.when(F.col(rank_col) <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    aggs.append(F.count(F.lit(1)).alias("queries"))
    return ranks.groupBy(*(by or [])).agg(*aggs)


def report_json(acc: DataFrame, delta: DataFrame) -> DataFrame:
    """SNK2: one-row nested report (overall, per category, deltas) as JSON
    text, runs and categories in the order of their names; write it with
    ``df.write.text`` / ``.json``."""
    overall = acc.filter(F.col("category").isNull())
    per = acc.filter(F.col("category").isNotNull())
    o = overall.groupBy("variant").agg(F.first(F.struct("total", "exact_acc", "substring_acc")).alias("overall"))
    c = per.groupBy("variant").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("category", F.struct("total", "exact_acc", "substring_acc"))))).alias("categories"))
    v = o.join(c, "variant", "left")
    by_name = lambda a, b: F.when(a["variant"] < b["variant"], -1).when(a["variant"] > b["variant"], 1).otherwise(0)
    runs = v.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", F.struct("overall", "categories"))), by_name))
                 .alias("runs"))
    d = delta.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.coalesce("category", F.lit("overall")), F.struct("exact_delta", "substring_delta"))))).alias("delta"))
    return runs.unionByName(d, allowMissingColumns=True).agg(
        F.to_json(F.struct(F.first("runs", ignorenulls=True).alias("runs"),
                           F.first("delta", ignorenulls=True).alias("delta"))).alias("report"))
