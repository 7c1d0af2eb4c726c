"""Download outcome analytics (DLO1-DLO5, RPT7).

Cloning is not built; attempts arrive as a log table
``(event_id, ts, full_name, success, size_bytes, error)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.ordering import seq_since

# --- fixed values ----------------------------------------------------------
# Download job defaults.
CLONE_TIMEOUT_SECONDS = 3600
RETRY_ATTEMPTS = 3
RETRY_DELAY_SECONDS = 60
# Failure classification, first match wins: (action, any of, all of) over the
# lower-cased error text; no match -> "retry".
FAILURE_RULES = (
    ("skip", ("repository not found", "404"), ()),
    ("skip", ("repository moved", "301"), ()),
    ("retry_extended", ("timeout",), ()),
    ("retry_later", ("could not read", "ssl"), ()),
    ("retry_later", (), ("remote: ", "error")),
    ("skip", ("does not exist", "not found"), ()),
)
SKIP_PREFIX = "skipped: "
OVERSIZE_MESSAGE = "skipped: repo size %dKB exceeds limit %dKB"
# ---------------------------------------------------------------------------


def classify_error(error: Column) -> Column:
    """DLO1: first matching rule of FAILURE_RULES on the lower-cased message."""
    e = F.lower(F.coalesce(error, F.lit("")))
    expr = None
    for action, any_of, all_of in FAILURE_RULES:
        cond = None
        if any_of:
            for t in any_of:
                cond = e.contains(t) if cond is None else cond | e.contains(t)
        else:
            for t in all_of:
                cond = e.contains(t) if cond is None else cond & e.contains(t)
        expr = F.when(cond, action) if expr is None else expr.when(cond, action)
    return expr.otherwise("retry")


def oversize_precheck(repos: DataFrame, max_size_kb: int | None) -> DataFrame:
    """DLO2: repositories refused before cloning, with the reason text."""
    if not max_size_kb:
        return repos.limit(0).select("full_name", F.lit(None).cast("string").alias("error"))
    big = repos.filter(F.col("size_kb") > max_size_kb)
    return big.select("full_name", F.format_string(
        OVERSIZE_MESSAGE, F.col("size_kb"), F.lit(max_size_kb)).alias("error"))


def retry_schedule(log: DataFrame, timeout: int = CLONE_TIMEOUT_SECONDS, attempts: int = RETRY_ATTEMPTS,
                   delay: int = RETRY_DELAY_SECONDS) -> DataFrame:
    """DLO3: attempt number, the timeout that attempt used, the action, whether
    it is terminal and the wait before the next attempt.  Attempts of a
    repository (log order) form chains: a chain ends with a success, a skip or
    its ``attempts``-th failure, and the next attempt is number 1 again.
    Numbering is skew-safe (see :mod:`functions.ordering`)."""
    action = F.when(F.col("success"), F.lit("done")).otherwise(classify_error(F.col("error")))
    since = seq_since(log.withColumn("action", action), ["full_name"], [F.col("ts"), F.col("event_id")],
                      F.col("action").isin("done", "skip"), name="_since")
    out = since.withColumn("attempt", (F.col("_since") - 1) % attempts + 1)
    terminal = (F.col("action") == "done") | (F.col("action") == "skip") | (F.col("attempt") >= attempts)
    return out.select(
        "event_id", "full_name", "attempt", "action",
        F.when(F.col("attempt") > 1, F.floor(F.lit(timeout) * 1.5)).otherwise(F.lit(timeout))
        .cast("bigint").alias("timeout_s"),
        terminal.alias("terminal"),
        F.when(terminal, F.lit(None).cast("bigint"))
        .when(F.col("action") == "retry_extended", F.lit(delay).cast("bigint"))
        .otherwise(F.col("attempt") * delay).cast("bigint").alias("next_delay_s"),
        F.when(F.col("action") == "skip", F.concat(F.lit(SKIP_PREFIX), F.coalesce("error", F.lit("unknown"))))
        .when(terminal & ~F.col("success"), F.coalesce("error", F.lit("unknown")))
        .alias("recorded_error"))


def batch_summary(log: DataFrame, legacy: bool = False) -> DataFrame:
    """DLO4: downloaded / failed / skipped / bytes.

    Skips are classified by the failure action (fix); ``legacy`` adds the
    reference's text search for "skipped" in the raw error as well.
    """
    action = classify_error(F.col("error"))
    skipped = ~F.col("success") & ((action == "skip") | F.coalesce(F.col("error").startswith("skipped:"), F.lit(False)))
    aggs = [
        F.count_if(F.col("success")).alias("total_downloaded"),
        F.count_if(~F.col("success") & ~skipped).alias("total_failed"),
        F.count_if(skipped).alias("total_skipped"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("size_bytes"))), F.lit(0)).cast("bigint")
        .alias("total_size_bytes"),
    ]
    if legacy:
        aggs.append(F.count_if(~F.col("success") & F.coalesce(F.col("error").contains("skipped"), F.lit(False)))
                    .alias("legacy_skipped"))
    return log.agg(*aggs)


def clone_path(catalog: DataFrame, base: str) -> DataFrame:
    """DLO5: ``base/owner/name`` clone folder of each repository."""
    return catalog.select("full_name", F.concat_ws("/", F.lit(base.rstrip("/")), "owner", "name").alias("clone_path"))


def crawl_summary(log: DataFrame, run_key: Column) -> DataFrame:
    """RPT7: per run, the counters of the full-crawl report."""
    action = classify_error(F.col("error"))
    skipped = ~F.col("success") & (action == "skip")
    return log.groupBy(run_key.alias("run_id")).agg(
        F.countDistinct("full_name").alias("repos_touched"),
        F.count_if(F.col("success")).alias("downloaded"),
        F.count_if(~F.col("success") & ~skipped).alias("failed"),
        F.count_if(skipped).alias("skipped"))


def crawl_report(events: DataFrame, log: DataFrame, run_key: Column) -> DataFrame:
    """RPT7 with all counters: per run the names discovered, the names queued for download
    (their first ``downloading`` event of the run), and the outcomes of the attempt log."""
    names = events.groupBy(run_key.alias("run_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.countDistinct(F.when(F.col("action") == "discovered", F.col("full_name"))).alias("discovered"),
        F.countDistinct(F.when(F.col("action") == "downloading", F.col("full_name"))).alias("queued"))
    done = crawl_summary(log, run_key).select("run_id", "downloaded", "failed", "skipped")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("discovered", "queued", "downloaded", "failed", "skipped")]
    return names.join(done, "run_id", "full_outer").select("run_id", "started_at", "ended_at", *zero)
