"""Star-band census queries (BND1-BND11, RPT6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import bands as bnd
from corpusflow.plans.registry import register
from corpusflow.sources.repo_json import parse_repo_json

# a small cap, so that bands of the test inputs exceed it
CAP = 20


def _snapshot(i):
    return parse_repo_json(i["raw_repo_json"])


def _tiers(spark, **kw):
    return bnd.tier_table(spark, **kw)


# ----------------------------------------------------------- oracle text

def _tier_rows(min_stars=50, niche=True, emerging=True, languages=None):
    rows = []
    if languages:
        tiers = [("custom", languages, min_stars)]
    else:
        tiers = [("mainstream", bnd.MAINSTREAM, max(min_stars, 50))]
        if niche:
            tiers.append(("niche", bnd.NICHE, 20))
        if emerging:
            tiers.append(("emerging", bnd.EMERGING, 10))
    for to, (t, langs, floor) in enumerate(tiers):
        for lo, lang in enumerate(langs):
            rows.append(f"('{t}', {to}, '{lang.lower()}', {lo}, {floor}, "
                        f"{bnd.START_THRESHOLDS.get(lang.lower(), bnd.DEFAULT_START)})")
    return ", ".join(rows)


_CUTS = ", ".join(f"({c})" for c in bnd.CUT_POINTS)

_SNAP_SQL = """
, snap as (select json_extract_string(value, '$.full_name') as full_name,
    coalesce(cast(json_extract(value, '$.stargazers_count') as int), 0) as stars,
    lower(json_extract_string(value, '$.language')) as lang,
    coalesce(cast(json_extract(value, '$.fork') as boolean), false) as fork
  from raw_repo_json)
, cuts(c) as (values {cuts})
""".format(cuts=_CUTS)


def _census_sql(p: str, tier_rows: str, target: int | None = None, progress: str | None = None,
                cap: int | None = None, early: bool = False) -> str:
    """CTE chain computing a census summary named ``{p}_s``."""
    done = ""
    if progress:
        done = f"""
, {p}_done as (select b.*, (exists (select 1 from {progress} g where g.tier = b.tier and g.language = b.language
                   and g.star_range_low = b.low)
                or exists (select 1 from {progress} g where g.tier = b.tier and g.language = b.language
                   and g.star_range_low = b.floor)) as completed from {p}_b0 b)"""
    else:
        done = f"\n, {p}_done as (select b.*, false as completed from {p}_b0 b)"
    tgt = (f"coalesce(sum(case when candidate then new else 0 end) over (order by tier_ord, lang_ord, band_ord "
           f"rows between unbounded preceding and 1 preceding), 0) < {target}") if target else "true"
    cap_at = "true" if cap is None else f"rk <= {cap}"
    cap_n = "9223372036854775807" if cap is None else str(cap)
    stop = f"""and coalesce(max(case when not completed and total = 0 then 1 else 0 end)
    over (partition by tier, language order by band_ord rows between unbounded preceding and 1 preceding), 0) = 0""" if early else ""
    return f"""
, {p}_t(tier, tier_ord, language, lang_ord, floor, start) as (values {tier_rows})
, {p}_lows as (select t.*, c.c as low from {p}_t t join cuts c on c.c >= t.floor and c.c <= t.start
    union all select t.*, t.floor as low from {p}_t t
    where not exists (select 1 from cuts c where c.c = t.floor and c.c <= t.start))
, {p}_b0 as (select *, cast(row_number() over (partition by tier, language order by low desc) as int) as band_ord,
    lag(low) over (partition by tier, language order by low desc) - 1 as high from {p}_lows){done}
, {p}_m as (select b.tier, b.language, b.low, s.full_name, s.stars from snap s join {p}_done b
    on s.lang = b.language and s.stars >= b.low and (b.high is null or s.stars <= b.high)
    where not s.fork and not b.completed)
, {p}_tot as (select tier, language, low, count(*) as total from {p}_m group by all)
, {p}_top as (select * from (select *, row_number() over (partition by tier, language, low
    order by stars desc, full_name) as rk from {p}_m) x where {cap_at})
, {p}_new as (select tier, language, low, count(distinct full_name) as new from {p}_top
    where full_name not in (select full_name from repo_catalog) group by all)
, {p}_s1 as (select b.*, coalesce(t.total, 0) as total, coalesce(n.new, 0) as new
    from {p}_done b left join {p}_tot t using (tier, language, low) left join {p}_new n using (tier, language, low))
, {p}_s2 as (select *, not completed {stop} as candidate from {p}_s1)
, {p}_s3 as (select *, candidate and {tgt} as ran from {p}_s2)
, {p}_s as (select tier, tier_ord, language, lang_ord, band_ord, low as star_range_low,
    high as star_range_high, completed, ran,
    case when ran then total else 0 end as total,
    least(case when ran then total else 0 end, {cap_n}) as returned,
    case when ran then total else 0 end > {cap_n} as truncated,
    case when ran then new else 0 end as new from {p}_s3)
"""


def _select_sql(p: str, rank: bool) -> str:
    return f"""
select t.tier, t.language, t.low as star_range_low, t.full_name, t.stars{", cast(t.rk as int) as rank" if rank else ""}
from {p}_top t join {p}_s s on s.tier = t.tier and s.language = t.language and s.star_range_low = t.low
where s.ran
"""


_FULL = _tier_rows()
_MAIN_ONLY = _tier_rows(niche=False, emerging=False)

# ----------------------------------------------------------------- queries


@register("bnd_census", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _FULL) + " select * from a_s")
def q_census(i):
    """BND1, BND2, BND4, BND11: census summary over the whole snapshot, one row per band."""
    return bnd.census(_snapshot(i), i["repo_catalog"], _tiers(i.spark))[0]


@register("bnd_selected", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _FULL) + _select_sql("a", False))
def q_selected(i):
    """BND4: every eligible row with its band."""
    return bnd.census(_snapshot(i), i["repo_catalog"], _tiers(i.spark))[1]


@register("bnd_capped", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _FULL, cap=CAP) + _select_sql("a", True))
def q_capped(i):
    """BND5: the 20 highest-starred rows of each band."""
    return bnd.census(_snapshot(i), i["repo_catalog"], _tiers(i.spark), cap=CAP)[1]


@register("bnd_early_stop", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _FULL, cap=CAP, early=True) + " select * from a_s")
def q_early_stop(i):
    """BND6: capped census that leaves a language at its first empty band."""
    return bnd.census(_snapshot(i), i["repo_catalog"], _tiers(i.spark), cap=CAP, early_stop=True)[0]


@register("bnd_census_target", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _FULL, 40) + " select * from a_s")
def q_census_target(i):
    """BND7: the census stops once 40 new repositories are stored."""
    return bnd.census(_snapshot(i), i["repo_catalog"], _tiers(i.spark), target=40)[0]


def _progress_sql(p: str) -> str:
    return f""", {p}_prog as (select tier, language, star_range_low, star_range_high, returned as repos_found
      from {p}_s where ran)"""


_RESUME_SQL = (_SNAP_SQL + _census_sql("a", _MAIN_ONLY) + _progress_sql("a")
               + _census_sql("b", _FULL, progress="a_prog"))


def _resume(i):
    """Progress of a census of the mainstream tier, and the full census after it."""
    snap, c = _snapshot(i), i["repo_catalog"]
    first, _ = bnd.census(snap, c, _tiers(i.spark, include_niche=False, include_emerging=False))
    prog1 = bnd.mark_complete(None, first)
    second, sel2 = bnd.census(snap, c, _tiers(i.spark), progress=prog1)
    return prog1, second, sel2


@register("bnd_resume", ["raw_repo_json", "repo_catalog"], _RESUME_SQL + " select * from b_s")
def q_resume(i):
    """BND9: second census resumes after a mainstream-only first run."""
    return _resume(i)[1]


@register("bnd_progress", ["raw_repo_json", "repo_catalog"], _RESUME_SQL + """
select tier, language, star_range_low, star_range_high, repos_found from a_prog
where not exists (select 1 from b_s where b_s.ran and b_s.tier = a_prog.tier and b_s.language = a_prog.language
                  and b_s.star_range_low = a_prog.star_range_low)
union all
select tier, language, star_range_low, star_range_high, returned as repos_found from b_s where ran
""")
def q_progress(i):
    """BND8: progress table after both runs (keyed replace)."""
    prog1, second, _ = _resume(i)
    return bnd.mark_complete(prog1, second)


@register("bnd_pending_bands", ["raw_repo_json", "repo_catalog"], _RESUME_SQL + """
select tier, language, band_ord, low as star_range_low, high as star_range_high from b_b0
where not exists (select 1 from a_prog g where g.tier = b_b0.tier and g.language = b_b0.language
                  and g.star_range_low = b_b0.low)
""")
def q_pending_bands(i):
    """BND9: ladder bands not recorded as complete after the first run."""
    prog1, _, _ = _resume(i)
    pend = bnd.pending_bands(bnd.ladder(_tiers(i.spark)), prog1)
    return pend.select("tier", "language", "band_ord", "star_range_low", "star_range_high")


_ALL_PROG = _RESUME_SQL + """
, allprog as (
  select tier, language, star_range_low, star_range_high, repos_found from a_prog
  where not exists (select 1 from b_s where b_s.ran and b_s.tier = a_prog.tier and b_s.language = a_prog.language
                    and b_s.star_range_low = a_prog.star_range_low)
  union all select tier, language, star_range_low, star_range_high, returned from b_s where ran)
"""


@register("bnd_clear_tier", ["raw_repo_json", "repo_catalog"], _ALL_PROG + """
select count(*) filter (where tier = 'mainstream') as removed,
       count(*) filter (where tier <> 'mainstream') as remaining from allprog
""")
def q_clear_tier(i):
    """BND10: clear the mainstream tier's progress; rows removed and kept."""
    prog1, second, _ = _resume(i)
    prog = bnd.mark_complete(prog1, second)
    _, counts = bnd.clear_progress(prog, "mainstream")
    return counts


@register("rpt_tier_progress", ["raw_repo_json", "repo_catalog"], _ALL_PROG + """
select tier, count(*) as queries_complete, cast(coalesce(sum(repos_found), 0) as bigint) as repos_found
from allprog group by rollup (tier)
""")
def q_tier_progress(i):
    """RPT6: progress per tier plus grand total (tier NULL)."""
    prog1, second, _ = _resume(i)
    return bnd.tier_progress(bnd.mark_complete(prog1, second))


@register("bnd_custom", ["raw_repo_json", "repo_catalog"],
          _SNAP_SQL + _census_sql("a", _tier_rows(min_stars=30, languages=["Rust", "Zig", "Lua"]))
          + " select * from a_s")
def q_custom(i):
    """BND11 custom-language mode: Rust, Zig, Lua down to 30 stars."""
    tiers = _tiers(i.spark, min_stars=30, languages=["Rust", "Zig", "Lua"])
    return bnd.census(_snapshot(i), i["repo_catalog"], tiers)[0]


@register("bnd_global", ["raw_repo_json"], _SNAP_SQL + """
select full_name, stars from snap where not fork and stars >= 100
""")
def q_global(i):
    """BND3: language-free census of every eligible row."""
    return bnd.global_census(_snapshot(i), min_stars=100)


@register("bnd_global_capped", ["raw_repo_json"], _SNAP_SQL + f"""
, g as (select full_name, stars from snap where not fork and stars >= 100)
, broad as (select * from g order by stars desc, full_name limit {CAP})
, gl as (select c.c as low from cuts c where c.c >= 100)
, gb as (select low, lag(low) over (order by low desc) - 1 as high from gl)
, gm as (select b.low, g.full_name, g.stars from g join gb b on g.stars >= b.low and (b.high is null or g.stars <= b.high))
, gtop as (select * from (select *, row_number() over (partition by low order by stars desc, full_name) as rk from gm) x
           where rk <= {CAP})
, gextra as (select * from gtop where full_name not in (select full_name from broad))
, gnew as (select b.low, coalesce(count(e.full_name), 0) as new from gb b left join gextra e using (low) group by b.low)
, gplan as (select low, (select count(*) from broad) + coalesce(sum(new) over (order by low desc rows between
      unbounded preceding and 1 preceding), 0) < 70 as ran from gnew)
select full_name, stars from (
  select full_name, stars from broad
  union all
  select e.full_name, e.stars from gextra e join gplan p using (low) where p.ran) x
order by stars desc, full_name limit 70
""")
def q_global_capped(i):
    """BND3 with the search limits: broad query, ladder, target of 70 rows."""
    return bnd.global_census(_snapshot(i), min_stars=100, target=70, cap=CAP)


@register("bnd_ladder_used", ["raw_repo_json"], _SNAP_SQL + _census_sql("z", _FULL).split(", z_m")[0] + """
select b.tier, b.language, b.band_ord, b.low as star_range_low, b.high as star_range_high
from z_b0 b where b.language in (select distinct lang from snap)
""")
def q_ladder_used(i):
    """BND1+BND2: band ladder of the languages present in the snapshot."""
    snap = _snapshot(i).select(F.lower("language").alias("language")).distinct()
    lad = bnd.ladder(_tiers(i.spark))
    return lad.join(snap, "language", "left_semi").select(
        "tier", "language", "band_ord", "star_range_low", "star_range_high")


@register("bnd_refresh", ["raw_repo_json", "repo_catalog"], _SNAP_SQL + _census_sql("a", _FULL) + """
, sel as (select distinct t.full_name from a_top t join a_s s on s.tier = t.tier and s.language = t.language
          and s.star_range_low = t.low where s.ran)
select is_new, count(*) as n from (
  select false as is_new from repo_catalog
  union all select true from sel where full_name not in (select full_name from repo_catalog)) x
group by is_new
""")
def q_refresh(i):
    """BND11 refresh mode: progress cleared, full census re-run, results
    upserted; catalog rows by new / existing."""
    stale = bnd.ladder(_tiers(i.spark)).select(
        "tier", "language", "star_range_low", "star_range_high", F.lit(0).cast("bigint").alias("repos_found"))
    cat2, _ = bnd.refresh(_snapshot(i), i["repo_catalog"], _tiers(i.spark), stale)
    return cat2.groupBy("is_new").agg(F.count(F.lit(1)).alias("n"))
