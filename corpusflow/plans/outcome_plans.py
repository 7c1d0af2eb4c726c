"""Download outcome queries (DLO1-DLO5, RPT7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import outcomes as out
from corpusflow.plans.registry import register

_CLASSIFY = """case
  when contains(lower(coalesce({e}, '')), 'repository not found') or contains(lower(coalesce({e}, '')), '404') then 'skip'
  when contains(lower(coalesce({e}, '')), 'repository moved') or contains(lower(coalesce({e}, '')), '301') then 'skip'
  when contains(lower(coalesce({e}, '')), 'timeout') then 'retry_extended'
  when contains(lower(coalesce({e}, '')), 'could not read') or contains(lower(coalesce({e}, '')), 'ssl') then 'retry_later'
  when contains(lower(coalesce({e}, '')), 'remote: ') and contains(lower(coalesce({e}, '')), 'error') then 'retry_later'
  when contains(lower(coalesce({e}, '')), 'does not exist') or contains(lower(coalesce({e}, '')), 'not found') then 'skip'
  else 'retry' end"""


@register("dlo_classify", ["download_log"], f"""
select event_id, full_name, error, {_CLASSIFY.format(e='error')} as action
from download_log where not success
""")
def q_classify(i):
    """DLO1: failure action of every failed attempt."""
    log = i["download_log"]
    return log.filter(~F.col("success")).select(
        "event_id", "full_name", "error", out.classify_error(F.col("error")).alias("action"))


@register("dlo_oversize", ["repo_catalog"], """
select full_name, format('skipped: repo size {}KB exceeds limit {}KB', size_kb, 5000) as error
from repo_catalog where status = 'pending' and size_kb > 5000
""")
def q_oversize(i):
    """DLO2: of all pending repositories, those over 5,000 KB are refused."""
    return out.oversize_precheck(i["repo_catalog"].filter(F.col("status") == "pending"), 5000)


@register("dlo_retry_schedule", ["download_log"], f"""
with e as (select *, case when success then 'done' else {_CLASSIFY.format(e='error')} end as action from download_log),
g as (select *, count(*) filter (where action in ('done', 'skip')) over (partition by full_name order by ts, event_id
        rows between unbounded preceding and 1 preceding) as ended from e),
a as (select *, (row_number() over (partition by full_name, ended order by ts, event_id) - 1) % 3 + 1 as attempt from g),
b as (select *, action in ('done', 'skip') or attempt >= 3 as terminal from a)
select event_id, full_name, attempt, action,
  cast(case when attempt > 1 then floor(3600 * 1.5) else 3600 end as bigint) as timeout_s,
  terminal,
  cast(case when terminal then null when action = 'retry_extended' then 60 else attempt * 60 end as bigint) as next_delay_s,
  case when action = 'skip' then concat('skipped: ', coalesce(error, 'unknown'))
       when terminal and not success then coalesce(error, 'unknown') end as recorded_error
from b
""")
def q_retry_schedule(i):
    """DLO3: attempt numbers, timeouts, terminal flags and back-off delays."""
    return out.retry_schedule(i["download_log"])


@register("dlo_batch_summary", ["download_log"], f"""
with a as (select *, not success and ({_CLASSIFY.format(e='error')} = 'skip'
                                      or coalesce(starts_with(error, 'skipped:'), false)) as skipped
           from download_log)
select count(*) filter (where success) as total_downloaded,
  count(*) filter (where not success and not skipped) as total_failed,
  count(*) filter (where skipped) as total_skipped,
  cast(coalesce(sum(size_bytes) filter (where success), 0) as bigint) as total_size_bytes,
  count(*) filter (where not success and coalesce(contains(error, 'skipped'), false)) as legacy_skipped
from a
""")
def q_batch_summary(i):
    """DLO4: downloaded / failed / skipped / bytes (plus the legacy count)."""
    return out.batch_summary(i["download_log"], legacy=True)


@register("dlo_clone_path", ["repo_catalog"], """
select full_name, concat('/data/repos/', owner, '/', name) as clone_path from repo_catalog
""")
def q_clone_path(i):
    """DLO5."""
    return out.clone_path(i["repo_catalog"], "/data/repos")


@register("rpt_crawl_summary", ["download_log"], f"""
select strftime(ts, '%Y-%m-%d') as run_id, count(distinct full_name) as repos_touched,
  count(*) filter (where success) as downloaded,
  count(*) filter (where not success and {_CLASSIFY.format(e='error')} <> 'skip') as failed,
  count(*) filter (where not success and {_CLASSIFY.format(e='error')} = 'skip') as skipped
from download_log group by 1
""")
def q_crawl_summary(i):
    """RPT7: per-day crawl summary."""
    return out.crawl_summary(i["download_log"], F.date_format("ts", "yyyy-MM-dd"))


@register("rpt_crawl_report", ["repo_events", "download_log"], f"""
, a as (select strftime(ts, '%Y-%m-%d') as run_id, min(ts) as started_at, max(ts) as ended_at,
    count(distinct full_name) filter (where action = 'discovered') as discovered,
    count(distinct full_name) filter (where action = 'downloading') as queued from repo_events group by 1)
, b as (select strftime(ts, '%Y-%m-%d') as run_id, count(*) filter (where success) as downloaded,
    count(*) filter (where not success and {_CLASSIFY.format(e='error')} <> 'skip') as failed,
    count(*) filter (where not success and {_CLASSIFY.format(e='error')} = 'skip') as skipped from download_log group by 1)
select run_id, started_at, ended_at, coalesce(discovered, 0) as discovered, coalesce(queued, 0) as queued,
  coalesce(downloaded, 0) as downloaded, coalesce(failed, 0) as failed, coalesce(skipped, 0) as skipped
from a full outer join b using (run_id)
""")
def q_crawl_report(i):
    """RPT7: per-day crawl report with the discovered and queued counters."""
    return out.crawl_report(i["repo_events"], i["download_log"], F.date_format("ts", "yyyy-MM-dd"))
