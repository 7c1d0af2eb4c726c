"""Keyed catalog maintenance (CAT1-CAT17).

The catalog is a DataFrame keyed by ``full_name``.  Parquet has no MERGE, so
every write operation returns the *next* catalog (to be written as a new
snapshot by :mod:`corpusflow.sources.snapshot`), never mutates in place.
Hot keys are safe: per-key work is done with aggregates (partial, map-side)
and joins on the key that AQE splits when skewed; no per-key window sorts a
hot key's rows inside one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.renames import resolve

META_COLS = ("stars", "language", "license_key", "size_kb", "default_branch", "fork", "archived", "updated_at")


def split_name(full_name: Column | None = None) -> tuple[Column, Column]:
    """``owner/name`` split; a name without ``/`` yields a NULL leaf."""
    parts = F.split(full_name if full_name is not None else F.col("full_name"), "/")
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def first_seen(batch: DataFrame, key: str = "full_name", order: str = "arrival") -> DataFrame:
    """CAT3: de-duplicate by key, earliest arrival wins.

    Implemented as a min-aggregate of ``struct(order, row)`` so a hot key is
    combined map-side instead of sorted inside one window task.
    """
    others = [c for c in batch.columns if c != key]
    best = F.min(F.struct(F.col(order), *[F.col(c) for c in others if c != order])).alias("_best")
    return batch.groupBy(key).agg(best).select(key, F.col(f"_best.{order}"),
                                               *[F.col(f"_best.{c}") for c in others if c != order])


def insert_discovered(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """CAT1: rows of ``batch`` whose name is not yet in the catalog.

    Returns the rows to insert (status ``pending``); ``metadata_updated_at``
    stays NULL, so inserted rows are immediately stale (kept behaviour).
    """
    fresh = first_seen(batch).join(catalog.select("full_name"), "full_name", "left_anti")
    owner, leaf = split_name()
    return fresh.select("full_name", owner.alias("owner"), leaf.alias("name"), *[c for c in META_COLS if c in fresh.columns],
                        F.lit("pending").alias("status"))


def upsert(catalog: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """CAT2: overwrite metadata of known names, insert unknown ones as pending.

    A NULL from the batch overwrites a known value (plain overwrite).  Status
    and download/processing state of known rows are preserved.  ``is_new``
    marks inserted rows.
    """
    now = now if now is not None else F.current_timestamp()
    b = first_seen(batch)
    bcols = [c for c in META_COLS if c in b.columns]
    b = b.select("full_name", *[F.col(c).alias(f"_b_{c}") for c in bcols], F.lit(True).alias("_in_batch"))
    c = catalog.withColumn("_in_cat", F.lit(True))
    j = c.join(b, "full_name", "full_outer")
    owner, leaf = split_name()
    out = []
    for col in catalog.columns:
        if col == "full_name":
            out.append(F.col("full_name"))
        elif col in bcols:
            out.append(F.when(F.col("_in_batch"), F.col(f"_b_{col}")).otherwise(F.col(col)).alias(col))
        elif col == "owner":
            out.append(F.coalesce(F.col("owner"), owner).alias("owner"))
        elif col == "name":
            out.append(F.coalesce(F.col("name"), leaf).alias("name"))
        elif col == "status":
            out.append(F.coalesce(F.col("status"), F.lit("pending")).alias("status"))
        elif col == "failure_count":
            out.append(F.coalesce(F.col("failure_count"), F.lit(0)).alias("failure_count"))
        else:
            out.append(F.col(col))
    out.append(F.when(F.col("_in_batch"), now).alias("metadata_updated_at"))
    out.append(F.col("_in_cat").isNull().alias("is_new"))
    return j.select(*out)


# --- status transitions -------------------------------------------------

# state column of each per-action field: (event action, event column)
_FIELDS = {
    "last_error": ("failed", "error"), "download_started_at": ("downloading", "ts"),
    "download_completed_at": ("downloaded", "ts"), "actual_size_bytes": ("downloaded", "size_bytes"),
    "local_path": ("downloaded", "path"), "processed_at": ("processed", "ts"),
    "commit_count": ("processed", "commit_count"),
}


#: state column that says how old a field is (a stored catalog's rows carry them)
_AGE = {"download_started_at": "download_started_at", "download_completed_at": "download_completed_at",
        "actual_size_bytes": "download_completed_at", "local_path": "download_completed_at",
        "processed_at": "processed_at", "commit_count": "processed_at"}


def _is(action: str) -> Column:
    return F.col("action") == action


def with_order(events: DataFrame) -> DataFrame:
    """Events with all optional columns and their replay order ``_ord`` = (ts, event_id)."""
    for c, t in (("error", "string"), ("size_bytes", "bigint"), ("path", "string"), ("commit_count", "bigint")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(t))
    return events.withColumn("_ord", F.struct(F.col("ts"), F.col("event_id")))


def partial_states(events: DataFrame) -> DataFrame:
    """Mergeable row of every name: its birth, latest status and the latest value of each
    field, each with its order key.  Combined inside the map tasks, so a busy name is no hot key."""
    ev = with_order(events)
    aggs = [F.min(F.when(_is("discovered"), F.col("_ord"))).alias("_birth"),
            F.max(F.when(F.col("action") != "discovered", F.struct("_ord", F.col("action").alias("v"), F.col("ts").alias("t")))).alias("_status")]
    for col, (action, value) in _FIELDS.items():
        hit = _is(action) & (F.col(value).isNotNull() if action == "failed" else F.lit(True))
        aggs.append(F.max(F.when(hit, F.struct("_ord", F.col(value).alias("v")))).alias(f"_e_{col}"))
    return ev.groupBy("full_name").agg(*aggs)


def merge_states(partials: DataFrame) -> DataFrame:
    """Partial rows of any batches, in any order and any number of times, as one row for each name."""
    return partials.groupBy("full_name").agg(F.min("_birth").alias("_birth"), *[
        F.max(c).alias(c) for c in ("_status", *[f"_e_{col}" for col in _FIELDS])])


def failed_events(events: DataFrame) -> DataFrame:
    """``full_name, _ord`` of the failures, each event once."""
    return with_order(events).where(_is("failed")).select("full_name", "_ord").distinct()


def apply_transitions(state: DataFrame, events: DataFrame) -> DataFrame:
    """CAT4-CAT8 in one set-based job: the whole next catalog.

    ``events``: ``event_id, ts, full_name, action`` plus optional ``error``,
    ``size_bytes``, ``path``, ``commit_count``.  Actions: ``discovered``,
    ``downloading``, ``downloaded``, ``processing``, ``processed``,
    ``failed``.  Replay order is ``(ts, event_id)`` and a repeated event counts
    once, so the result is a function of the state and the *set* of events.  A
    name that is not in ``state`` exists from its first ``discovered`` event on;
    earlier events for it are no-ops (an UPDATE of a missing row).  The latest
    status event wins, ``failure_count`` adds one per failure, the latest event
    of an action sets that action's fields (a null error keeps the old one).  All other columns of the
    state are carried.

    A stored catalog (one with ``status_updated_at``) keeps a status or field that is newer
    than the events' one.  It does not know which events it has seen: batches that may
    repeat events of earlier ones go through :func:`corpusflow.streaming.streams.status_fold`.

    Events are aggregated per name before anything is joined, so a busy name
    is combined inside the map tasks; only failures are told apart by event.
    """
    return apply_states(state, partial_states(events), failed_events(events))


def apply_states(state: DataFrame, partials: DataFrame, failed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The next catalog from one partial row for each name and the distinct failures;
    ``counted``: ``full_name, failures`` that were counted before."""
    per = failed.groupBy("full_name").agg(F.count(F.lit(1)).alias("_failures"), F.min("_ord").alias("_first_failure"))
    partials = partials.join(per, "full_name", "left")
    j = state.withColumn("_known", F.lit(True)).join(partials, "full_name", "full_outer")
    j = j.filter(F.col("_known") | F.col("_birth").isNotNull())
    # failures before the birth of a new name, counted from the failed events of such names alone
    late = j.filter(F.col("_known").isNull() & (F.col("_first_failure") < F.col("_birth"))).select("full_name", "_birth")
    early = (failed.join(late, "full_name").filter(F.col("_ord") < F.col("_birth"))
             .groupBy("full_name").agg(F.count(F.lit(1)).alias("_early")))
    j = j.join(early, "full_name", "left")
    before = F.lit(0)
    if counted is not None:
        j = j.join(counted.select("full_name", F.col("failures").alias("_before")), "full_name", "left")
        before = F.coalesce("_before", F.lit(0))
    stored = "status_updated_at" in state.columns

    def counts(event: str, age: str | None) -> Column:
        found = F.col(event)
        ok = found.isNotNull() & (F.coalesce(F.col("_known"), F.lit(False)) | (found["_ord"] >= F.col("_birth")))
        if stored and age in state.columns:
            ok = ok & (F.col(age).isNull() | (found["_ord"]["ts"] >= F.col(age)))
        return ok

    def of_state(col: str) -> Column:
        return F.col(col) if col in state.columns else F.lit(None)

    owner, leaf = split_name()
    now = counts("_status", "status_updated_at")
    new = {
        "status": F.coalesce(F.when(now, F.col("_status.v")), of_state("status"), F.lit("pending")),
        "failure_count": (F.coalesce(of_state("failure_count"), F.lit(0)) + before + F.coalesce("_failures", F.lit(0))
                          - F.coalesce("_early", F.lit(0))).cast("int"),
        "status_updated_at": F.coalesce(F.when(now, F.col("_status.t")), of_state("status_updated_at")),
    }
    for col in _FIELDS:
        value = F.when(counts(f"_e_{col}", _AGE.get(col)), F.col(f"_e_{col}.v")).otherwise(of_state(col))
        new[col] = value.cast("bigint") if col in ("actual_size_bytes", "commit_count") else value
    for col, part in (("owner", owner), ("name", leaf)):
        if col in state.columns:
            new[col] = F.when(F.col("_known"), F.col(col)).otherwise(part)
    cols = [c for c in state.columns if c != "is_new"] + [c for c in new if c not in state.columns]
    return j.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in cols], F.col("_known").isNull().alias("is_new"))


# --- set-wide commands (conditional projections) --------------------------

def set_status_where(catalog: DataFrame, cond: Column, new_status: str,
                     clear: tuple[str, ...] = ()) -> DataFrame:
    """Generic ``UPDATE ... SET status = x WHERE cond``; adds ``changed``."""
    hit = F.coalesce(cond, F.lit(False))
    cols = []
    for c in catalog.columns:
        if c == "status":
            cols.append(F.when(hit, F.lit(new_status)).otherwise(F.col("status")).alias("status"))
        elif c in clear:
            cols.append(F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return catalog.select(*cols, hit.alias("changed"))


def reset_stuck_downloads(catalog: DataFrame, now: _dt.datetime, timeout_minutes: int = 120) -> DataFrame:
    """CAT9: downloading rows started strictly before now - timeout become pending."""
    cutoff = F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(timeout_minutes), F.lit(0))
    cond = (F.col("status") == "downloading") & (F.col("download_started_at") < cutoff)
    return set_status_where(catalog, cond, "pending")


def reset_all_downloading(catalog: DataFrame) -> DataFrame:
    """CAT10."""
    return set_status_where(catalog, F.col("status") == "downloading", "pending")


def reset_all_processing(catalog: DataFrame) -> DataFrame:
    """CAT11."""
    return set_status_where(catalog, F.col("status") == "processing", "downloaded")


def retry_failed(catalog: DataFrame, max_failures: int = 3, exclude_skipped: bool = False) -> DataFrame:
    """CAT12: failed rows under the failure cap go back to pending."""
    cond = (F.col("status") == "failed") & (F.col("failure_count") < max_failures)
    if exclude_skipped:
        cond = cond & ~F.coalesce(F.col("last_error").startswith("skipped:"), F.lit(False))
    return set_status_where(catalog, cond, "pending")


def reset_for_reprocessing(catalog: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """CAT14: processed rows (all, or those in ``names``) back to downloaded."""
    cond = F.col("status") == "processed"
    if names is not None:
        flagged = catalog.join(names.select("full_name").distinct().withColumn("_pick", F.lit(True)), "full_name", "left")
        out = set_status_where(flagged, cond & F.col("_pick").isNotNull(), "downloaded", clear=("commit_count", "processed_at"))
        return out.drop("_pick")
    return set_status_where(catalog, cond, "downloaded", clear=("commit_count", "processed_at"))


def rename(catalog: DataFrame, renames: DataFrame) -> DataFrame:
    """CAT13: apply a batch of ``(old_name, new_name)``: chains, swaps and redirects as
    :mod:`corpusflow.operators.renames` decides them; a rename onto a name that another row
    keeps is refused (the key is unique) and reported in ``rename_refused``."""
    r = resolve(catalog.select("full_name"), renames)
    j = catalog.join(r, catalog["full_name"] == r["old_name"], "left")
    ok = F.col("new_name").isNotNull() & ~F.col("refused")
    owner, leaf = split_name(F.col("new_name"))
    moved = {"full_name": F.col("new_name"), "owner": owner, "name": leaf}
    cols = [F.when(ok, moved[c]).otherwise(F.col(c)).alias(c) if c in moved else F.col(c) for c in catalog.columns]
    return j.select(*cols, F.when(ok, F.col("old_name")).alias("renamed_from"),
                    F.coalesce(F.col("refused"), F.lit(False)).alias("rename_refused"))


def detect_renames(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """CAT15: same repository id, name differs ignoring case -> rename pair."""
    f = fresh.select(F.col("id"), F.col("full_name").alias("new_name"))
    return (catalog.select("id", F.col("full_name").alias("old_name")).join(f, "id")
            .filter(F.lower("old_name") != F.lower("new_name"))
            .select("id", "old_name", "new_name"))


def validate_presence(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """CAT16: is each catalog name (case-insensitive) still served?"""
    names = fresh.select(F.lower("full_name").alias("_k")).distinct().withColumn("present", F.lit(True))
    return (catalog.withColumn("_k", F.lower("full_name")).join(names, "_k", "left")
            .select("full_name", F.coalesce(F.col("present"), F.lit(False)).alias("present")))


def run_log(events: DataFrame, run_key: Column, config: dict) -> DataFrame:
    """CAT17: one run row per ``run_key`` with start/end, three counters and
    the run configuration as JSON text."""
    cfg = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))
    return (events.groupBy(run_key.alias("run_id"))
            .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
                 F.count_if(F.col("action") == "discovered").alias("repos_discovered"),
                 F.count_if(F.col("action") == "downloaded").alias("repos_downloaded"),
                 F.count_if(F.col("action") == "failed").alias("repos_failed"))
            .withColumn("config_json", cfg))
