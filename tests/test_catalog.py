"""Hand-made fixtures for the catalog semantics (keep / fix decisions)."""

import datetime as dt

from pyspark.sql import functions as F

from corpusflow.operators import catalog as cat
from corpusflow.operators import outcomes as out
from corpusflow.operators import selection as sel

CAT_SCHEMA = ("full_name string, owner string, name string, stars int, language string, size_kb long, "
              "status string, failure_count int, last_error string, download_started_at timestamp_ntz")


def _catalog(spark):
    t = dt.datetime(2024, 3, 31, 0, 0)
    rows = [
        ("a/x", "a", "x", 10, "py", None, "pending", 0, None, None),
        ("a/y", "a", "y", 10, None, 5000, "pending", 0, None, None),
        ("b/z", "b", "z", 30, "go", 10, "downloading", 0, None, t - dt.timedelta(minutes=120)),
        ("b/w", "b", "w", 5, "go", 10, "downloading", 0, None, t - dt.timedelta(minutes=121)),
        ("c/v", "c", "v", 7, "go", 10, "downloading", 0, None, None),
        ("d/u", "d", "u", 1, "rs", 10, "failed", 2, "skipped: gone", None),
        ("d/t", "d", "t", 1, "rs", 10, "failed", 3, "boom", None),
    ]
    return spark.createDataFrame(rows, CAT_SCHEMA)


def test_pending_ties_and_null_size(spark):
    c = _catalog(spark)
    got = [r.full_name for r in sel.pending_batch(c, 10, max_size_kb=100).collect()]
    assert got == ["a/x"]  # NULL size passes, 5000 > 100 is filtered
    got = [r.full_name for r in sel.pending_batch(c, 10).collect()]
    assert got == ["a/x", "a/y"]  # equal stars: name tie-break
    got = [r.full_name for r in sel.pending_batch(c, 10, max_size_kb=0).collect()]
    assert got == ["a/x", "a/y"]  # 0 means no size limit


def test_stuck_reset_is_strict(spark):
    c = _catalog(spark)
    out_ = {r.full_name: r.status for r in cat.reset_stuck_downloads(c, dt.datetime(2024, 3, 31), 120).collect()}
    assert out_["b/z"] == "downloading"  # exactly 120 minutes: not stuck
    assert out_["b/w"] == "pending"
    assert out_["c/v"] == "downloading"  # NULL start never resets


def test_retry_failed_includes_skipped(spark):
    c = _catalog(spark)
    got = {r.full_name: r.status for r in cat.retry_failed(c, 3).collect()}
    assert got["d/u"] == "pending" and got["d/t"] == "failed"
    got = {r.full_name: r.status for r in cat.retry_failed(c, 3, exclude_skipped=True).collect()}
    assert got["d/u"] == "failed"


def test_upsert_overwrites_with_null(spark):
    c = _catalog(spark)
    batch = spark.createDataFrame([(0, "a/x", 99, None), (1, "a/x", 5, "c"), (2, "noslash", 1, "py")],
                                  "arrival long, full_name string, stars int, language string")
    got = {r.full_name: r for r in cat.upsert(c, batch).collect()}
    assert got["a/x"].stars == 99 and got["a/x"].language is None  # first arrival wins, NULL overwrites
    assert got["a/x"].status == "pending" and not got["a/x"].is_new
    assert got["noslash"].is_new and got["noslash"].name is None and got["noslash"].owner == "noslash"


def test_transitions_existence_and_failures(spark):
    c = _catalog(spark)
    ev = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1, 1), "n/new", "downloading"),   # before discovery: no-op
        (2, dt.datetime(2024, 1, 1, 2), "n/new", "discovered"),
        (3, dt.datetime(2024, 1, 1, 3), "n/new", "failed"),
        (4, dt.datetime(2024, 1, 1, 3), "d/t", "failed"),
        (5, dt.datetime(2024, 1, 1, 3), "d/t", "downloaded"),      # same time, higher id wins
        (6, dt.datetime(2024, 1, 1, 4), "x/never", "downloaded"),  # unknown, never discovered
    ], "event_id long, ts timestamp_ntz, full_name string, action string")
    got = {r.full_name: r for r in cat.apply_transitions(c, ev).collect()}
    assert got["n/new"].status == "failed" and got["n/new"].failure_count == 1 and got["n/new"].is_new
    assert got["d/t"].status == "downloaded" and got["d/t"].failure_count == 4
    assert "x/never" not in got
    again = {r.full_name: r for r in cat.apply_transitions(c, ev.union(ev)).collect()}
    assert again["d/t"].failure_count == 4  # idempotent by event id


def test_classifier_order(spark):
    df = spark.createDataFrame([("Could not read from remote: 404",), ("remote: fatal error",), ("TIMEOUT",),
                                ("branch not found",), ("weird",), (None,)], "e string")
    got = [r.a for r in df.select(out.classify_error(F.col("e")).alias("a")).collect()]
    assert got == ["skip", "retry_later", "retry_extended", "skip", "retry", "retry"]


def test_rename_refuses_collision(spark):
    c = _catalog(spark)
    r = spark.createDataFrame([("a/x", "a/y"), ("b/z", "b/zz")], "old_name string, new_name string")
    got = {r.renamed_from: r.full_name for r in cat.rename(c, r).collect() if r.renamed_from}
    assert got == {"b/z": "b/zz"}


def test_pages_by_key_meet_every_row_once(spark):
    rows = [(f"o/{k:02d}", None if k % 4 == 0 else k % 3, "downloaded" if k % 5 else "pending", "en", None) for k in range(40)]
    c = spark.createDataFrame(rows, "full_name string, stars int, status string, language string, local_path string")
    stars = {r[0]: r[1] for r in rows}
    seen, page = [], [r.full_name for r in sel.downloaded_page(c, 7).collect()]
    while page:
        seen += page
        page = [r.full_name for r in sel.downloaded_after(c, stars[page[-1]], page[-1], 7).collect()]
    assert seen == [r.full_name for r in sel.downloaded_page(c, 100).collect()] and len(seen) == 32


def test_named_reset_with_repeated_names(spark):
    c = spark.createDataFrame([("a", "processed", 3, None), ("b", "processed", 4, None), ("c", "pending", 0, None)],
                              "full_name string, status string, commit_count int, processed_at timestamp")
    names = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "full_name string")
    got = {(r.full_name, r.status, r.commit_count) for r in cat.reset_for_reprocessing(c, names).collect()}
    assert got == {("a", "downloaded", None), ("b", "processed", 4), ("c", "pending", 0)}
