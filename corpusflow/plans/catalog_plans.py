"""Catalog queries: CAT, SEL, RPT, SRC1/SRC2/SRC4."""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import catalog as cat
from corpusflow.operators import reports as rpt
from corpusflow.operators import selection as sel
from corpusflow.operators import sketches as ske
from corpusflow.plans.registry import register
from corpusflow.session import checkpoint_dir
from corpusflow.sources.repo_json import parse_repo_json, repo_paths

# "Now" of every date rule is this fixed instant, never the clock.
NOW_DATE = _dt.date(2024, 3, 31)
NOW_TS = _dt.datetime(2024, 3, 31, 0, 0, 0)
REPOS_BASE = "/data/repos"


# ---------------------------------------------------------------- reports

@register("rpt_status_counts", ["repo_catalog"], """
select s.status, coalesce(c.n, 0) as n
from (values ('pending'), ('downloading'), ('downloaded'), ('processing'), ('processed'), ('failed')) s(status)
left join (select status, count(*) as n from repo_catalog group by status) c on c.status = s.status
""")
def q_status_counts(i):
    """RPT1: zero-filled status counts."""
    return rpt.status_counts(i["repo_catalog"])


@register("rpt_data_totals", ["repo_catalog"], """
select count(*) as total_repos_with_data,
  cast(coalesce(sum(actual_size_bytes), 0) as bigint) as total_size_bytes,
  cast(coalesce(sum(commit_count), 0) as bigint) as total_commits
from repo_catalog where status in ('downloaded', 'processed')
""")
def q_data_totals(i):
    """RPT2."""
    return rpt.data_totals(i["repo_catalog"])


@register("rpt_unique_languages", ["repo_catalog"], """
select count(distinct language) as unique_languages from repo_catalog
""")
def q_unique_languages(i):
    """RPT3."""
    return rpt.unique_languages(i["repo_catalog"])


@register("rpt_distinct_rollup", ["repo_events"], """
select strftime(ts, '%Y-%m') as month, count(distinct full_name) as exact, true as within_bound from repo_events group by 1
""")
def q_distinct_rollup(i):
    """RPT3: distinct repositories per month, exact and merged from one stored sketch a day; the
    estimate is held against four standard errors."""
    ev = i["repo_events"]
    path = f"{checkpoint_dir(i.spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    ske.distinct_sketches(ev, [F.date_format("ts", "yyyy-MM-dd").alias("day")], "full_name").write.parquet(path)
    months = ske.rolled_up(i.spark.read.parquet(path), [F.substring("day", 1, 7).alias("month")])
    exact = ev.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct("full_name").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(4 * ske.STANDARD_ERROR * F.col("exact"), F.lit(1.0))
    return exact.join(months, "month").select("month", "exact", near.alias("within_bound"))


@register("rpt_language_distribution", ["repo_catalog"], """
select language, count(*) as n from repo_catalog where language is not null
group by language order by n desc, language limit 20
""")
def q_language_distribution(i):
    """RPT4: top-20 languages."""
    return rpt.language_distribution(i["repo_catalog"], top=20)


@register("rpt_progress", ["repo_catalog"], """
with p as (
  select count(*) filter (where status = 'pending') as pending,
    count(*) filter (where status = 'downloading') as downloading,
    count(*) filter (where status = 'downloaded') as downloaded,
    count(*) filter (where status = 'processing') as processing,
    count(*) filter (where status = 'processed') as processed,
    count(*) filter (where status = 'failed') as failed,
    coalesce(sum(actual_size_bytes) filter (where status in ('downloaded', 'processed')), 0) as size_bytes,
    cast(coalesce(sum(commit_count) filter (where status in ('downloaded', 'processed')), 0) as bigint) as commits
  from repo_catalog)
select pending + downloading + downloaded + processed + failed as total_repos,
  downloaded + processed as completed, failed, pending, downloading as in_progress, processing,
  round(coalesce((downloaded + processed) * 100.0 / nullif(pending + downloading + downloaded + processed + failed, 0), 0.0), 6)
    as progress_percent,
  round(size_bytes / 1073741824.0, 6) as total_size_gb, commits as total_commits
from p
""")
def q_progress(i):
    """RPT5."""
    return rpt.progress(i["repo_catalog"])


_DIRS_SQL = """
dirs as (select array_to_string(string_split(path, '/')[1:5], '/') as repo_dir,
           cast(sum(length) as bigint) as size_bytes, count(*) as n_files
         from file_inventory where length is not null group by 1)
"""


@register("src_dir_sizes", ["file_inventory"], ", " + _DIRS_SQL + " select * from dirs")
def q_dir_sizes(i):
    """SRC4: bytes and file count per clone folder."""
    return rpt.repo_dirs(i["file_inventory"], base_depth=2)


@register("rpt_reconcile_missing", ["repo_catalog", "file_inventory"], ", " + _DIRS_SQL + """
select c.full_name, c.status as previous_status, 'failed' as status,
  concat('reconciled: local directory missing (was ', c.status, ', ~',
         cast(cast(round_even(coalesce(c.size_kb, 0) / 1024.0, 0) as bigint) as varchar), ' MB)') as last_error
from repo_catalog c
where c.status in ('downloaded', 'processed') and c.local_path is not null
  and not exists (select 1 from dirs d where d.repo_dir = c.local_path)
""")
def q_reconcile_missing(i):
    """RPT8 rows."""
    return rpt.reconcile_missing(i["repo_catalog"], rpt.repo_dirs(i["file_inventory"], base_depth=2))


@register("rpt_reconcile_summary", ["repo_catalog", "file_inventory"], ", " + _DIRS_SQL + """
select count(*) as checked,
  count(*) filter (where d.repo_dir is null) as missing,
  count(*) filter (where d.repo_dir is not null) as ok
from repo_catalog c left join dirs d on d.repo_dir = c.local_path
where c.status in ('downloaded', 'processed') and c.local_path is not null
""")
def q_reconcile_summary(i):
    """RPT8 counts."""
    return rpt.reconcile_summary(i["repo_catalog"], rpt.repo_dirs(i["file_inventory"], base_depth=2))


@register("rpt_oversize", ["file_inventory"], ", " + _DIRS_SQL + """
select repo_dir, size_bytes, round(size_bytes / 1073741824.0, 3) as size_gb
from dirs where size_bytes > 2147483648 order by size_bytes desc, repo_dir
""")
def q_oversize(i):
    """RPT9: folders over 2 GB."""
    return rpt.oversize(rpt.repo_dirs(i["file_inventory"], base_depth=2))


@register("rpt_oversize_total", ["file_inventory"], ", " + _DIRS_SQL + """
select count(*) as n_repos, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes_freed
from dirs where size_bytes > 2147483648
""")
def q_oversize_total(i):
    """RPT9 total."""
    return rpt.oversize_total(rpt.repo_dirs(i["file_inventory"], base_depth=2))


@register("rpt_oversize_limit", ["file_inventory"], ", " + _DIRS_SQL + """
select repo_dir, size_bytes, round(size_bytes / 1073741824.0, 3) as size_gb
from dirs where size_bytes > 104857600 order by size_bytes desc, repo_dir
""")
def q_oversize_limit(i):
    """RPT9 with a limit of 100 MB, which folders of every scale exceed."""
    return rpt.oversize(rpt.repo_dirs(i["file_inventory"], base_depth=2), 100 << 20)


# -------------------------------------------------------------- selection

_META = """full_name, stars, language, license_key, coalesce(size_kb, 0) as size_kb,
  coalesce(default_branch, 'main') as default_branch, coalesce(fork, false) as fork,
  coalesce(archived, false) as archived"""


@register("sel_pending", ["repo_catalog"], f"""
select {_META} from repo_catalog
where status = 'pending' and (size_kb is null or size_kb <= 20000)
order by stars desc, full_name limit 100
""")
def q_pending(i):
    """SEL1: next 100 pending repositories under 20,000 KB."""
    return sel.pending_batch(i["repo_catalog"], batch_size=100, max_size_kb=20000)


@register("sel_pending_random", ["repo_catalog"], f"""
select {_META} from repo_catalog where status = 'pending'
order by md5(concat('7', ':', full_name)), full_name limit 50
""")
def q_pending_random(i):
    """SEL2: 50 pending repositories in seeded hash order (no size filter)."""
    return sel.pending_batch(i["repo_catalog"], batch_size=50, randomize=True, seed=7)


@register("sel_downloaded_page", ["repo_catalog"], """
select full_name, local_path, language from repo_catalog where status = 'downloaded'
order by stars desc, full_name limit 25 offset 10
""")
def q_downloaded_page(i):
    """SEL3: third page-ish: 25 rows after the first 10."""
    return sel.downloaded_page(i["repo_catalog"], batch_size=25, offset=10)


@register("sel_downloaded_after", ["repo_catalog"], """
with d as (select full_name, local_path, language, row_number() over (order by stars desc nulls last, full_name) as n
           from repo_catalog where status = 'downloaded')
select full_name, local_path, language, cast((n - 1) // 25 as int) as page from d where n <= 75
""")
def q_downloaded_after(i):
    """SEL3 by key: three pages of 25 rows, each from the last row of the page before."""
    catalog, pages, last = i["repo_catalog"], [], None
    stars = catalog.select("full_name", "stars")
    for k in range(3):
        page = sel.downloaded_page(catalog, 25) if last is None else sel.downloaded_after(catalog, last["stars"], last["full_name"], 25)
        pages.append(page.withColumn("page", F.lit(k)))
        # the row a caller would keep: one row, the last of its page
        end = page.join(stars, "full_name").orderBy(F.col("stars").asc_nulls_first(), F.col("full_name").desc()).first()
        if end is None:
            break
        last = end
    return reduce(DataFrame.unionByName, pages)


@register("sel_local_paths", ["repo_catalog"], """
select full_name, local_path, status, size_kb from repo_catalog
where status in ('downloaded', 'processed') and local_path is not null
""")
def q_local_paths(i):
    """SEL4."""
    return sel.with_local_paths(i["repo_catalog"])


@register("sel_stale", ["repo_catalog"], """
select full_name, stars from repo_catalog
where metadata_updated_on is null or metadata_updated_on < date '2024-03-31' - interval 30 day
order by stars desc, full_name limit 1000
""")
def q_stale(i):
    """SEL5: stale metadata (older than 30 days before 2024-03-31)."""
    return sel.stale(i["repo_catalog"], NOW_DATE, 30, 1000)


@register("sel_queue_count", ["repo_catalog"], """
select least(count(*), 100) as queued from repo_catalog where status = 'pending' and stars >= 20000
""")
def q_queue_count(i):
    """SEL6."""
    return sel.queue_count(i["repo_catalog"], limit=100, min_stars=20000)


@register("sel_count_failed", ["repo_catalog"], """
select count(*) as n from repo_catalog where status = 'failed'
""")
def q_count_failed(i):
    """SEL7."""
    return sel.count_by_status(i["repo_catalog"], "failed")


@register("src_repo_paths", ["repo_catalog"], """
select full_name, language, coalesce(local_path, concat('/data/repos/', owner, '/', name)) as repo_path
from repo_catalog where status = 'downloaded'
""")
def q_repo_paths(i):
    """SRC2."""
    return repo_paths(i["repo_catalog"], REPOS_BASE, "downloaded")


# ------------------------------------------------------------ catalog ops

@register("src_parse_repo_json", ["raw_repo_json"], """
select arrival, cast(json_extract(value, '$.id') as bigint) as id,
  json_extract_string(value, '$.full_name') as full_name,
  coalesce(cast(json_extract(value, '$.stargazers_count') as int), 0) as stars,
  json_extract_string(value, '$.language') as language,
  json_extract_string(value, '$.license.key') as license_key,
  coalesce(cast(json_extract(value, '$.size') as bigint), 0) as size_kb,
  coalesce(json_extract_string(value, '$.default_branch'), 'main') as default_branch,
  coalesce(cast(json_extract(value, '$.fork') as boolean), false) as fork,
  coalesce(cast(json_extract(value, '$.archived') as boolean), false) as archived,
  cast(replace(json_extract_string(value, '$.created_at'), 'Z', '') as timestamp) as created_at,
  cast(replace(json_extract_string(value, '$.updated_at'), 'Z', '') as timestamp) as updated_at
from raw_repo_json
""")
def q_parse_repo_json(i):
    """SRC1: typed rows with defaults from raw JSON."""
    df = parse_repo_json(i["raw_repo_json"])
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")) \
             .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@register("cat_first_seen", ["discovered_batch"], """
select full_name, arrival, stars, language from (
  select *, row_number() over (partition by full_name order by arrival) as rn from discovered_batch) t
where rn = 1
""")
def q_first_seen(i):
    """CAT3: de-duplicate a discovery batch, first arrival wins."""
    return cat.first_seen(i["discovered_batch"]).select("full_name", "arrival", "stars", "language")


@register("cat_insert_discovered", ["repo_catalog", "discovered_batch"], """
select b.full_name, split_part(b.full_name, '/', 1) as owner,
  case when strpos(b.full_name, '/') > 0 then split_part(b.full_name, '/', 2) end as name,
  b.stars, b.language, 'pending' as status
from (select *, row_number() over (partition by full_name order by arrival) as rn from discovered_batch) b
where b.rn = 1 and b.full_name not in (select full_name from repo_catalog)
""")
def q_insert_discovered(i):
    """CAT1: rows a bulk insert adds (existing names ignored)."""
    return cat.insert_discovered(i["repo_catalog"], i["discovered_batch"]).select(
        "full_name", "owner", "name", "stars", "language", "status")


@register("cat_upsert", ["repo_catalog", "discovered_batch"], """
with b as (select * from (select *, row_number() over (partition by full_name order by arrival) as rn
                          from discovered_batch) t where rn = 1)
select coalesce(c.full_name, b.full_name) as full_name,
  coalesce(c.owner, split_part(b.full_name, '/', 1)) as owner,
  case when b.full_name is not null then b.stars else c.stars end as stars,
  case when b.full_name is not null then b.language else c.language end as language,
  case when b.full_name is not null then b.license_key else c.license_key end as license_key,
  case when b.full_name is not null then b.size_kb else c.size_kb end as size_kb,
  case when b.full_name is not null then b.fork else c.fork end as fork,
  coalesce(c.status, 'pending') as status, coalesce(c.failure_count, 0) as failure_count,
  c.full_name is null as is_new
from repo_catalog c full outer join b on b.full_name = c.full_name
""")
def q_upsert(i):
    """CAT2: upsert a discovery batch into the catalog."""
    out = cat.upsert(i["repo_catalog"], i["discovered_batch"], now=F.lit(NOW_TS))
    return out.select("full_name", "owner", "stars", "language", "license_key", "size_kb", "fork",
                      "status", "failure_count", "is_new")


_TRANSITIONS_SQL = """
, ev as (select *, row_number() over (partition by full_name order by ts, event_id) as ord from transition_events),
birth as (select full_name, min(ord) as b from ev where action = 'discovered' group by full_name),
eff as (select ev.* from ev left join birth using (full_name)
        where ev.full_name in (select full_name from repo_catalog) or ev.ord >= birth.b),
agg as (select full_name,
  arg_max(action, ord) filter (where action <> 'discovered') as e_status,
  count(*) filter (where action = 'failed') as e_fail,
  arg_max(error, ord) filter (where action = 'failed') as e_error,
  max(ts) filter (where action <> 'discovered') as e_status_ts,
  arg_max(ts, ord) filter (where action = 'downloading') as e_started,
  arg_max(ts, ord) filter (where action = 'downloaded') as e_completed,
  arg_max(path, ord) filter (where action = 'downloaded') as e_path,
  arg_max(ts, ord) filter (where action = 'processed') as e_processed,
  arg_max(size_bytes, ord) filter (where action = 'downloaded') as e_size,
  count(*) filter (where action = 'downloaded') as n_dl,
  arg_max(commit_count, ord) filter (where action = 'processed') as e_commits,
  count(*) filter (where action = 'processed') as n_pr
  from eff group by full_name)
select coalesce(c.full_name, a.full_name) as full_name,
  coalesce(a.e_status, c.status, 'pending') as status,
  cast(coalesce(c.failure_count, 0) + coalesce(a.e_fail, 0) as int) as failure_count,
  coalesce(a.e_error, c.last_error) as last_error,
  coalesce(a.e_started, c.download_started_at) as download_started_at,
  cast(case when a.n_dl > 0 then a.e_size else c.actual_size_bytes end as bigint) as actual_size_bytes,
  cast(case when a.n_pr > 0 then a.e_commits else c.commit_count end as bigint) as commit_count,
  a.e_completed as download_completed_at, a.e_processed as processed_at, a.e_status_ts as status_updated_at,
  case when a.n_dl > 0 then a.e_path else c.local_path end as local_path,
  c.id, c.stars, c.language, c.license_key, c.size_kb, c.default_branch, c.fork, c.archived, c.metadata_updated_on,
  case when c.full_name is null then split_part(a.full_name, '/', 1) else c.owner end as owner,
  case when c.full_name is null then split_part(a.full_name, '/', 2) else c.name end as name,
  c.full_name is null as is_new
from repo_catalog c full outer join agg a on a.full_name = c.full_name
"""


@register("cat_apply_transitions", ["repo_catalog", "transition_events"], _TRANSITIONS_SQL)
def q_apply_transitions(i):
    """CAT4-CAT8: replay status events onto the catalog; all columns."""
    return cat.apply_transitions(i["repo_catalog"], i["transition_events"])


@register("cat_reset_stuck", ["repo_catalog"], """
select full_name, case when changed then 'pending' else status end as status, changed from (
  select full_name, status,
    coalesce(status = 'downloading' and download_started_at < timestamp '2024-03-31 00:00:00' - interval 120 minute, false)
      as changed from repo_catalog) t
""")
def q_reset_stuck(i):
    """CAT9: downloads started over 120 minutes before 'now' go back to pending."""
    return cat.reset_stuck_downloads(i["repo_catalog"], NOW_TS, 120).select("full_name", "status", "changed")


@register("cat_reset_all_downloading", ["repo_catalog"], """
select full_name, case when status = 'downloading' then 'pending' else status end as status,
  status = 'downloading' as changed from repo_catalog
""")
def q_reset_all_downloading(i):
    """CAT10."""
    return cat.reset_all_downloading(i["repo_catalog"]).select("full_name", "status", "changed")


@register("cat_reset_all_processing", ["repo_catalog"], """
select full_name, case when status = 'processing' then 'downloaded' else status end as status,
  status = 'processing' as changed from repo_catalog
""")
def q_reset_all_processing(i):
    """CAT11."""
    return cat.reset_all_processing(i["repo_catalog"]).select("full_name", "status", "changed")


@register("cat_retry_failed", ["repo_catalog"], """
select full_name, case when status = 'failed' and failure_count < 3 then 'pending' else status end as status,
  status = 'failed' and failure_count < 3 as changed from repo_catalog
""")
def q_retry_failed(i):
    """CAT12: failed rows with fewer than 3 failures are re-queued."""
    return cat.retry_failed(i["repo_catalog"], 3).select("full_name", "status", "changed")


@register("cat_reset_reprocessing", ["repo_catalog"], """
select full_name, case when status = 'processed' then 'downloaded' else status end as status,
  case when status = 'processed' then null else commit_count end as commit_count,
  status = 'processed' as changed from repo_catalog
""")
def q_reset_reprocessing(i):
    """CAT14: all processed rows back to downloaded, counts cleared."""
    return cat.reset_for_reprocessing(i["repo_catalog"]).select("full_name", "status", "commit_count", "changed")


@register("cat_reset_named", ["repo_catalog", "transition_events"], """
with w as (select *, status = 'processed' and full_name in (select full_name from transition_events where action = 'processed') as hit
           from repo_catalog)
select full_name, case when hit then 'downloaded' else status end as status, case when hit then null else commit_count end as commit_count,
  hit as changed from w
""")
def q_reset_named(i):
    """CAT14 for given names, which may repeat: those that the events report as processed."""
    names = i["transition_events"].filter(F.col("action") == "processed")
    return cat.reset_for_reprocessing(i["repo_catalog"], names).select("full_name", "status", "commit_count", "changed")


_FRESH = """
, fresh as (select cast(json_extract(value, '$.id') as bigint) as id,
                   json_extract_string(value, '$.full_name') as full_name from raw_repo_json)
"""


@register("cat_detect_renames", ["repo_catalog", "raw_repo_json"], _FRESH + """
select c.id, c.full_name as old_name, f.full_name as new_name
from repo_catalog c join fresh f on f.id = c.id where lower(c.full_name) <> lower(f.full_name)
""")
def q_detect_renames(i):
    """CAT15: renamed repositories (same id, different name ignoring case)."""
    fresh = parse_repo_json(i["raw_repo_json"])
    return cat.detect_renames(i["repo_catalog"], fresh)


@register("cat_rename", ["repo_catalog", "raw_repo_json"], _FRESH + """
, r as (select c.full_name as old_name, f.full_name as new_name
        from repo_catalog c join fresh f on f.id = c.id where lower(c.full_name) <> lower(f.full_name))
select case when r.old_name is not null and r.new_name not in (select full_name from repo_catalog)
            then r.new_name else c.full_name end as full_name,
  case when r.old_name is not null and r.new_name not in (select full_name from repo_catalog)
       then split_part(r.new_name, '/', 1) else c.owner end as owner,
  case when r.old_name is not null and r.new_name not in (select full_name from repo_catalog)
       then split_part(r.new_name, '/', 2) else c.name end as name,
  case when r.old_name is not null and r.new_name not in (select full_name from repo_catalog)
       then r.old_name end as renamed_from
from repo_catalog c left join r on r.old_name = c.full_name
""")
def q_rename(i):
    """CAT13 fed by CAT15: apply detected renames to the catalog."""
    c = i["repo_catalog"]
    renames = cat.detect_renames(c, parse_repo_json(i["raw_repo_json"]))
    return cat.rename(c, renames).select("full_name", "owner", "name", "renamed_from")


@register("cat_rename_chains", ["repo_catalog", "rename_batch"], """
, target as (  -- follow a name over names that are no rows
  select old_name, case when exists (select 1 from repo_catalog c where c.full_name = r.new_name) then new_name
    else coalesce((select min(q.new_name) from rename_batch q where q.old_name = r.new_name), r.new_name) end as new_name
  from rename_batch r where exists (select 1 from repo_catalog c where c.full_name = r.old_name))
, walk as (  -- the rows that have to move for each row, up to a circle
  with recursive w as (
    select old_name, new_name, new_name as spot, 1 as n from target
    union all
    select w.old_name, w.new_name, t.new_name, n + 1 from w join target t on t.old_name = w.spot where w.spot <> w.old_name and n < 10)
  select * from w)
, ends as (
  select old_name, any_value(new_name) as new_name, bool_or(spot = old_name) as circle, arg_max(spot, n) as last from walk group by old_name)
, r as (select old_name, new_name, not circle and exists (select 1 from repo_catalog c where c.full_name = last) as refused from ends)
select case when r.refused = false then r.new_name else c.full_name end as full_name,
  case when r.refused = false then split_part(r.new_name, '/', 1) else c.owner end as owner,
  case when r.refused = false then split_part(r.new_name, '/', 2) else c.name end as name,
  case when r.refused = false then r.old_name end as renamed_from, coalesce(r.refused, false) as rename_refused
from repo_catalog c left join r on r.old_name = c.full_name
""")
def q_rename_chains(i):
    """CAT13: chains, swaps, redirects and refused renames in one batch."""
    return cat.rename(i["repo_catalog"], i["rename_batch"]).select("full_name", "owner", "name", "renamed_from", "rename_refused")


@register("cat_validate", ["repo_catalog", "raw_repo_json"], _FRESH + """
select c.full_name, exists (select 1 from fresh f where lower(f.full_name) = lower(c.full_name)) as present
from repo_catalog c
""")
def q_validate(i):
    """CAT16: catalog names still present in the fresh metadata."""
    return cat.validate_presence(i["repo_catalog"], parse_repo_json(i["raw_repo_json"]))


@register("cat_run_log", ["transition_events"], """
select strftime(ts, '%Y-%m-%d') as run_id, min(ts) as started_at, max(ts) as ended_at,
  count(*) filter (where action = 'discovered') as repos_discovered,
  count(*) filter (where action = 'downloaded') as repos_downloaded,
  count(*) filter (where action = 'failed') as repos_failed,
  '{"target_repo_count":100000,"max_concurrent_downloads":10,"retry_attempts":3}' as config_json
from transition_events group by 1
""")
def q_run_log(i):
    """CAT17: one run row per day of events, with config JSON."""
    cfg = {"target_repo_count": 100000, "max_concurrent_downloads": 10, "retry_attempts": 3}
    return cat.run_log(i["transition_events"], F.date_format("ts", "yyyy-MM-dd"), cfg)


@register("snk_catalog_snapshot", ["repo_catalog", "discovered_batch"], """
with b as (select * from (select *, row_number() over (partition by full_name order by arrival) as rn
                          from discovered_batch) t where rn = 1)
select coalesce(c.full_name, b.full_name) as full_name,
  case when b.full_name is not null then b.stars else c.stars end as stars,
  coalesce(c.status, 'pending') as status
from repo_catalog c full outer join b on b.full_name = c.full_name
""")
def q_catalog_snapshot(i):
    """SNK1: the upserted catalog written as a new versioned snapshot in the
    shared checkpoint folder and read back from it."""
    from corpusflow.sources.snapshot import read_snapshot, write_snapshot
    from corpusflow.streaming.streams import scratch

    root = scratch(i.spark, "catalog")
    write_snapshot(i["repo_catalog"], root)
    nxt = cat.upsert(read_snapshot(i.spark, root), i["discovered_batch"], now=F.lit(NOW_TS))
    v = write_snapshot(nxt, root, sort_within=("status", "stars"))
    return read_snapshot(i.spark, root, v).select("full_name", "stars", "status")


@register("sel_pending_snapshot", ["repo_catalog"], f"""
select {_META} from repo_catalog
where status = 'pending' and (size_kb is null or size_kb <= 20000)
order by stars desc, full_name limit 100
""")
def q_pending_snapshot(i):
    """SEL1 on the stored catalog: the snapshot is partitioned by status and
    sorted by stars inside files, so the status filter prunes partitions and
    the size filter is pushed into the Parquet scan."""
    from corpusflow.sources.snapshot import read_snapshot, write_snapshot
    from corpusflow.streaming.streams import scratch

    root = scratch(i.spark, "catalog_by_status")
    write_snapshot(i["repo_catalog"], root, partition_by=("status",), sort_within=("stars",))
    return sel.pending_batch(read_snapshot(i.spark, root), batch_size=100, max_size_kb=20000)
