"""Run telemetry aggregates (TEL1-TEL9).

Inputs are logged rows: ``step_metric(epoch, step, name, value)``,
attention weights ``(example, pos, weight)``, document scores.  Everything
is a (partial) aggregate; per-group top-k uses WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_EPS = 1e-8


def _rounded_ratio(units: Column, count: Column, unit_digits: int, digits: int) -> Column:
    """``units / 10^unit_digits / count`` rounded half away from zero to
    ``digits`` decimals with integer arithmetic (exact, order-independent)."""
    d = count * (10 ** (unit_digits - digits))
    q = F.floor((F.abs(units) * 2 + d) / (d * 2))
    return F.signum(units) * q / float(10 ** digits)


def epoch_means(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """TEL1: per epoch and metric, the reference's mean over *all* steps of
    the epoch and the mean over the steps that logged the metric.

    Values are summed as exact integers of 1e-8 units, so the means do not
    depend on the order in which partitions are combined."""
    units = F.round(F.col("value") * 1e8).cast("bigint")
    steps = metrics.groupBy("epoch").agg(F.countDistinct("step").alias("_steps"))
    per = metrics.groupBy("epoch", "name").agg(F.sum(units).alias("_u"), F.count("value").alias("_n"))
    return per.join(steps, "epoch").select(
        "epoch", "name", _rounded_ratio(F.col("_u"), F.col("_steps"), 8, digits).alias("mean_over_steps"),
        _rounded_ratio(F.col("_u"), F.col("_n"), 8, digits).alias("mean_over_logged"))


def derived_metrics(steps: DataFrame, loss: str = "loss", enc_grad: str = "encoder_grad_norm",
                    base_grad: str = "grad_norm") -> DataFrame:
    """TEL2: perplexity = exp(min(loss, 20)); gradient ratio with a 1e-8 floor."""
    return steps.withColumn("perplexity", F.exp(F.least(F.col(loss), F.lit(20.0)))) \
                .withColumn("grad_ratio", F.col(enc_grad) / F.greatest(F.col(base_grad), F.lit(LOG_EPS)))


def entropy(probs: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """TEL3: ``-sum p ln(p + 1e-8)`` per ``keys``."""
    return probs.groupBy(*keys).agg((-F.sum(F.col(p) * F.log(F.col(p) + LOG_EPS))).alias("entropy"))


def needle_precision(weights: DataFrame, chunks: DataFrame, needles: DataFrame, key: str = "example_id"
                     ) -> DataFrame:
    """TEL4: attention mass on the needle chunk's token span.

    The span starts after the tokens of all earlier chunks: a conditional
    sum per example (an aggregate, so an example with very many chunks is
    still combined map-side); only that one span is joined to the
    positions (no position x chunk pairs).  Where weights carry their ``chunk_idx``, see
    :func:`chunk_needle_precision`."""
    nd = needles.select(key, F.col("needle_chunk_idx").alias("_nc"))
    span = (chunks.join(nd, key)
            .groupBy(key).agg(
                F.coalesce(F.sum(F.when(F.col("chunk_idx") < F.col("_nc"), F.col("n_tokens"))), F.lit(0)).alias("start"),
                F.sum(F.when(F.col("chunk_idx") == F.col("_nc"), F.col("n_tokens"))).alias("_len"))
            .select(key, "start", (F.col("start") + F.col("_len")).alias("end")))
    j = weights.join(span, key)
    return j.groupBy(key).agg(
        (F.sum(F.when((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), F.col("weight"))
               .otherwise(0.0)) / F.sum("weight")).alias("needle_precision"))


def chunk_needle_precision(weights: DataFrame, needles: DataFrame, key: str = "example_id") -> DataFrame:
    """TEL4 from weights with their chunk: mass is summed per (example, chunk) before
    anything is joined, so a row per chunk meets the needle, not a row per token."""
    mass = weights.groupBy(key, "chunk_idx").agg(F.sum("weight").alias("_w"))
    j = mass.join(needles.select(key, F.col("needle_chunk_idx").alias("_nc")), key)
    inside = F.sum(F.when(F.col("chunk_idx") == F.col("_nc"), F.col("_w")).otherwise(0.0))
    return j.groupBy(key).agg((inside / F.sum("_w")).alias("needle_precision"))


def top_concentration(weights: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """TEL5: share of attention mass on the ``k`` largest weights."""
    total = weights.groupBy(*keys).agg(F.sum("weight").alias("_t"))
    w = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), F.col("pos"))
    top = weights.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k) \
                 .groupBy(*keys).agg(F.sum("weight").alias("_k"))
    return top.join(total, keys).select(*keys, (F.col("_k") / F.col("_t")).alias("top_concentration"))


def routing_losses(scores: DataFrame, batch: list[str], doc_index: str, head: str | None = None,
                   sparsity_weight: float = 0.01, balance_weight: float = 0.01) -> DataFrame:
    """TEL6: sparsity = mean entropy of each query's scores; balance =
    minus the entropy of the batch-mean scores per document index; total =
    weighted sum (sign as in the reference code).  ``scores``: batch keys,
    query_id, doc index, score (and optional head)."""
    hk = [head] if head else []
    ent = scores.groupBy(*batch, *hk, "query_id").agg(
        (-F.sum(F.col("score") * F.log(F.col("score") + LOG_EPS))).alias("_h"))
    spars = ent.groupBy(*batch, *hk).agg(F.avg("_h").alias("_s"))
    nq = scores.groupBy(*batch, *hk).agg(F.countDistinct("query_id").alias("_nq"))
    mean = scores.groupBy(*batch, *hk, doc_index).agg(F.sum("score").alias("_sum")).join(nq, batch + hk) \
                 .withColumn("_m", F.col("_sum") / F.col("_nq"))
    bal = mean.groupBy(*batch, *hk).agg((F.sum(F.col("_m") * F.log(F.col("_m") + LOG_EPS))).alias("_b"))
    per_head = spars.join(bal, batch + hk)
    out = per_head.groupBy(*batch).agg(F.avg("_s").alias("sparsity"), F.avg("_b").alias("balance"))
    return out.withColumn("routing_loss", sparsity_weight * F.col("sparsity") + balance_weight * F.col("balance"))


def run_sanity(steps: DataFrame, loss: str = "loss", gate: str = "gate_value", grad: str = "grad_norm") -> DataFrame:
    """TEL7: first vs last loss and gate, mean gradient norm, NaN check, flags."""
    def logged(c):  # order by step among the steps that logged the metric
        return F.when(F.col(c).isNotNull(), F.col("step"))

    s = steps.agg(
        F.min_by(loss, logged(loss)).alias("first_loss"), F.max_by(loss, logged(loss)).alias("last_loss"),
        F.min_by(gate, logged(gate)).alias("first_gate"), F.max_by(gate, logged(gate)).alias("last_gate"),
        F.avg(grad).alias("mean_grad_norm"),
        F.bool_or(F.isnan(F.col(loss)) | F.isnan(F.col(grad))).alias("any_nan"))
    return s.withColumn("loss_decreased", F.col("last_loss") < F.col("first_loss")) \
            .withColumn("gate_moved", F.abs(F.col("last_gate") - F.col("first_gate")) > 1e-6) \
            .withColumn("grads_flow", F.col("mean_grad_norm") > 0) \
            .withColumn("passed", F.col("loss_decreased") & F.col("grads_flow") & ~F.coalesce("any_nan", F.lit(False)))


def run_checks(steps: DataFrame) -> DataFrame:
    """TEL7, all ten values: first and last loss and gate, mean encoder gradient norm, and the
    four checks with their conjunction.  A step that does not log the gate or the encoder's
    norm counts as 0 there; steps without a loss are no steps."""
    s = steps.where(F.col("loss").isNotNull()).select(
        "step", "loss", F.coalesce("gate_value", F.lit(0.0)).alias("g"), F.coalesce("encoder_grad_norm", F.lit(0.0)).alias("e"))
    a = s.agg(F.min_by("loss", "step").alias("loss_start"), F.max_by("loss", "step").alias("loss_end"),
              F.min_by("g", "step").alias("gate_start"), F.max_by("g", "step").alias("gate_end"),
              F.avg("e").alias("encoder_grad_mean"), F.max_by("e", "step").alias("_last"),
              (~F.coalesce(F.bool_or(F.isnan("loss")), F.lit(False))).alias("no_nan"))
    flags = {"loss_decreased": F.col("loss_end") < F.col("loss_start"), "gate_increased": F.col("gate_end") > F.col("gate_start"),
             "encoder_receiving_gradients": F.col("_last") > 0}
    a = a.withColumns(flags)
    return a.withColumn("passed", F.col("loss_decreased") & F.col("gate_increased") & F.col("encoder_receiving_gradients") & F.col("no_nan")).drop("_last")


def l2_rollup(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """TEL8: sqrt of summed squares per group."""
    return values.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("l2_norm"))


def round_diversity(topk: DataFrame, keys: list[str], round_col: str = "round") -> DataFrame:
    """TEL9: distinct documents among the top-k of each round, and overlap
    with the previous round (self-join on query and document)."""
    distinct = topk.groupBy(round_col).agg(F.countDistinct(*keys, "doc_id").alias("distinct_docs"))
    prev = topk.select(*keys, "doc_id", (F.col(round_col) + 1).alias(round_col))
    overlap = topk.join(prev, keys + ["doc_id", round_col]).groupBy(round_col) \
                  .agg(F.count(F.lit(1)).alias("overlap_with_previous"))
    return distinct.join(overlap, round_col, "left").fillna(0, ["overlap_with_previous"])


def gate_means(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """TEL2: mean gate value and mean absolute gate value of each epoch, summed
    as exact integers like :func:`epoch_means`."""
    units = F.round(F.col("value") * 1e8).cast("bigint")
    g = metrics.filter(F.col("name") == "gate_value").groupBy("epoch").agg(
        F.sum(units).alias("_u"), F.sum(F.abs(units)).alias("_a"), F.count("value").alias("_n"))
    return g.select("epoch", _rounded_ratio(F.col("_u"), F.col("_n"), 8, digits).alias("avg_gate"),
                    _rounded_ratio(F.col("_a"), F.col("_n"), 8, digits).alias("avg_abs_gate"), F.col("_n").alias("steps"))
