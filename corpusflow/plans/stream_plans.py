"""Streaming queries (STR1-STR6): each runs a file stream over the driver's
tables to completion (``availableNow``) and returns the sink as a batch
DataFrame; the oracle is the batch-equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans.catalog_plans import _TRANSITIONS_SQL
from corpusflow.plans.registry import register
from corpusflow.sources.fixtures import FIXTURES
from corpusflow.streaming import streams as st


def _stream_fixture(i, name: str, stream_table: str, stream=None):
    """Apply fixture ``name`` with ``stream_table`` read as a file stream
    (nested fixtures follow; other inputs stay static)."""
    if name == stream_table:
        return stream if stream is not None else st.read_table_stream(i.spark, i.sf_dir, name)
    if name not in FIXTURES:
        return i[name]
    fx = FIXTURES[name]
    frames = {d: _stream_fixture(i, d, stream_table, stream) for d in fx.deps}
    return i.spark.sql(fx.spark_sql, **frames)


@register("str_status_fold", ["repo_catalog", "transition_events"], _TRANSITIONS_SQL.replace(
    "  c.full_name is null as is_new\n", "  c.full_name is null as is_new_unused\n"))
def q_status_fold(i):
    """STR1: status events landed by a stream and folded into the catalog; all columns."""
    return _folded(i, _stream_fixture(i, "transition_events", "events"))


def _folded(i, events, **more):
    cat0 = i["repo_catalog"]
    out = st.status_fold(events, cat0, st.scratch(i.spark, "fold"), **more)
    known = cat0.select("full_name", F.lit(False).alias("is_new_unused"))
    return out.join(known, "full_name", "left").withColumn("is_new_unused", F.coalesce("is_new_unused", F.lit(True)))


def _landed(i, table: str, files: int, order):
    """A table of the driver as a stream of several files, one for each micro-batch."""
    folder = st.scratch(i.spark, f"landed-{table}")
    rows = i[table]
    rows.withColumn("_file", order).repartition(files, "_file").sortWithinPartitions("_file").write.partitionBy("_file").parquet(folder)
    return i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@register("str_status_fold_epochs", ["repo_catalog", "transition_events"], _TRANSITIONS_SQL.replace(
    "  c.full_name is null as is_new\n", "  c.full_name is null as is_new_unused\n"))
def q_status_fold_epochs(i):
    """STR1 over ten micro-batches: events dealt to files by a hash, so they come in no order; the
    base is merged every four epochs."""
    events = _stream_fixture(i, "transition_events", "events", _landed(i, "events", 10, F.pmod(F.xxhash64("event_id"), F.lit(10))))
    return _folded(i, events, compact_every=4)


_STUCK_SQL = _TRANSITIONS_SQL.replace("select coalesce(c.full_name, a.full_name) as full_name,", """, folded as (
select coalesce(c.full_name, a.full_name) as full_name,""") + """)
select full_name,
  case when status = 'downloading'
        and download_started_at < (select max(ts) from transition_events) - interval 120 minute
       then 'pending' else status end as status,
  failure_count
from folded
"""


@register("str_stuck_timeout", ["repo_catalog", "transition_events"], _STUCK_SQL)
def q_stuck_timeout(i):
    """STR2: the fold, with downloads reset whose event-time timer (120 minutes) went off."""
    cat0, events = i["repo_catalog"], _stream_fixture(i, "transition_events", "events")
    fired = st.stuck_downloads(events, cat0, st.scratch(i.spark, "timers"), 120)
    out = st.reset_stuck(st.status_fold(events, cat0, st.scratch(i.spark, "stuck")), fired)
    return out.select("full_name", "status", "failure_count")


@register("str_window_counts", ["repo_events"], """
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, action, count(*) as n
from repo_events group by all
""")
def q_window_counts(i):
    """STR3: daily status-event counts per action with a 1-hour watermark."""
    ev = _stream_fixture(i, "repo_events", "events")
    agg = st.window_counts(ev, "1 day", "1 hour")
    return st.run_latest(agg, st.scratch(i.spark, "win"), ["window_start", "action"])


@register("str_first_seen", ["repo_catalog", "transition_events"], """
select distinct full_name from transition_events
where action = 'discovered' and full_name not in (select full_name from repo_catalog)
""")
def q_first_seen(i):
    """STR4: discoveries of names new to the catalog, de-duplicated."""
    ev = _stream_fixture(i, "transition_events", "events").filter(F.col("action") == "discovered")
    return st.first_seen_stream(ev.select("full_name"), i["repo_catalog"], st.scratch(i.spark, "seen"))


@register("str_memory_refresh", ["documents", "documents_prev"], """
with cur as (select doc_id, sha256(text) as h from documents),
old as (select doc_id, sha256(text) as h from documents_prev)
select 'encoded' as origin, count(*) as n from cur left join old using (doc_id) where old.h is null or old.h <> cur.h
union all select 'kept', count(*) from cur join old using (doc_id) where old.h = cur.h
union all select 'stored', count(*) from old where doc_id not in (select doc_id from cur)
""")
def q_memory_refresh(i):
    """STR5: landed documents refresh the memory store incrementally."""
    docs = st.read_table_stream(i.spark, i.sf_dir, "documents").select("doc_id", "text")
    store = i["documents_prev"].select("doc_id", F.sha2("text", 256).alias("content_hash"))
    out = st.memory_refresh_stream(docs, store, st.scratch(i.spark, "mem"))
    return out.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


_SKIP = """case
  when contains(lower(coalesce(error, '')), 'repository not found') or contains(lower(coalesce(error, '')), '404') then 1
  when contains(lower(coalesce(error, '')), 'repository moved') or contains(lower(coalesce(error, '')), '301') then 1
  when contains(lower(coalesce(error, '')), 'timeout') then 0
  when contains(lower(coalesce(error, '')), 'could not read') or contains(lower(coalesce(error, '')), 'ssl') then 0
  when contains(lower(coalesce(error, '')), 'remote: ') and contains(lower(coalesce(error, '')), 'error') then 0
  when contains(lower(coalesce(error, '')), 'does not exist') or contains(lower(coalesce(error, '')), 'not found') then 1
  else 0 end"""


@register("str_failure_share", ["download_log"], f"""
with w as (select *, unnest([0, 1, 2, 3]) as k from download_log),
s as (select *, time_bucket(interval 6 hour, ts) - k * interval 6 hour as ws from w)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as attempts,
  count(*) filter (where not success) as failures,
  count(*) filter (where not success and {_SKIP} = 1) as skips
from s where ts >= ws and ts < ws + interval 1 day group by ws
""")
def q_failure_share(i):
    """STR6: failure share over 1-day windows sliding by 6 hours."""
    log = _stream_fixture(i, "download_log", "events")
    agg = st.failure_share(log, "1 day", "6 hours", "1 hour")
    return st.run_latest(agg, st.scratch(i.spark, "share"), ["window_start"])


@register("str_attempt_sessions", ["download_log"], """
with o as (select *, lag(ts) over (partition by full_name order by ts, event_id) as prev from download_log),
g as (select *, sum(case when prev is null or ts >= prev + interval 2 hour then 1 else 0 end)
        over (partition by full_name order by ts, event_id) as sid from o),
s as (select full_name, min(ts) as s0, max(ts) + interval 2 hour as s1,
        count(*) as attempts, count(*) filter (where success) as successes from g group by full_name, sid)
select full_name, strftime(s0, '%Y-%m-%d %H:%M:%S.%f') as session_start,
  strftime(s1, '%Y-%m-%d %H:%M:%S.%f') as session_end, attempts, successes
from s where s1 <= (select max(ts) from download_log) - interval 1 hour
""")
def q_attempt_sessions(i):
    """STR6: per-repository attempt chains as 2-hour session windows; a
    session is emitted once the watermark (1 hour) has passed its end."""
    log = _stream_fixture(i, "download_log", "events")
    agg = st.attempt_sessions(log, "2 hours", "1 hour")
    return st.run_append(agg, st.scratch(i.spark, "sess"))


@register("str_all_sessions", ["download_log"], """
with o as (select *, lag(ts) over (partition by full_name order by ts, event_id) as prev from download_log),
g as (select *, sum(case when prev is null or ts >= prev + interval 2 hour then 1 else 0 end)
        over (partition by full_name order by ts, event_id) as sid from o),
s as (select full_name, min(ts) as s0, max(ts) + interval 2 hour as s1,
        count(*) as attempts, count(*) filter (where success) as successes from g group by full_name, sid)
select full_name, strftime(s0, '%Y-%m-%d %H:%M:%S.%f') as session_start,
  strftime(s1, '%Y-%m-%d %H:%M:%S.%f') as session_end, attempts, successes,
  s1 > (select max(ts) from download_log) - interval 1 hour as open
from s
""")
def q_all_sessions(i):
    """STR6: all attempt chains as 2-hour sessions, those still open at the end with a flag."""
    log = _stream_fixture(i, "download_log", "events")
    return st.all_sessions(log, i["download_log"], "2 hours", "1 hour", st.scratch(i.spark, "sessions"))
