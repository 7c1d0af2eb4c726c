"""Commit curation queries (SRC3, SRC5, COM1-COM14, SNK3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import commits as com
from corpusflow.operators import diffs as dif
from corpusflow.plans.registry import register

CFG = com.CommitFilter()

# DuckDB twins of the record columns.
_REC = """
, rec as (select repo, sha, parent_sha, seq, author, message, diff,
    list_filter(string_split(coalesce(files_text, ''), chr(10)), lambda x: x <> '') as files_changed,
    coalesce(try_cast(nullif(regexp_extract(shortstat, '(\\d+) insertion', 1), '') as int), 0) as additions,
    coalesce(try_cast(nullif(regexp_extract(shortstat, '(\\d+) deletion', 1), '') as int), 0) as deletions,
    parent_sha is null as is_root
  from commits)
, cur as (select * from rec
  where length(regexp_replace(message, '^\\s+|\\s+$', '', 'g')) >= 10
    and len(files_changed) <= 20 and octet_length(encode(diff)) <= 100000
    and not starts_with(lower(message), 'merge '))
"""


@register("src_parse_log", ["commits"], """
select repo, regexp_extract(log_line, '^([^|]*)\\|([^|]*)\\|([^|]*)\\|([^|]*)\\|(.*)$', 1) as sha,
  nullif(split_part(trim(regexp_extract(log_line, '^([^|]*)\\|([^|]*)\\|', 2)), ' ', 1), '') as parent_sha,
  regexp_extract(log_line, '^([^|]*)\\|([^|]*)\\|([^|]*)\\|([^|]*)\\|(.*)$', 3) as author,
  regexp_extract(log_line, '^([^|]*)\\|([^|]*)\\|([^|]*)\\|([^|]*)\\|(.*)$', 4) as authored_at,
  regexp_extract(log_line, '^([^|]*)\\|([^|]*)\\|([^|]*)\\|([^|]*)\\|(.*)$', 5) as message
from commits where regexp_matches(log_line, '^([^|]*)\\|([^|]*)\\|([^|]*)\\|([^|]*)\\|')
""")
def q_parse_log(i):
    """SRC3: parse the log export (author names with a bar shift fields)."""
    good, _ = com.parse_log_lines(i["commits"].select("repo", "log_line"))
    return good.select("repo", "sha", "parent_sha", "author", "authored_at", "message")


@register("com_first_parent_limit", ["commits"], """
select repo, sha, seq from (select *, row_number() over (partition by repo order by seq desc, sha) as rn
  from commits) t where rn <= 3
""")
def q_first_parent_limit(i):
    """COM1: newest three commits per repository."""
    return com.first_parent_list(i["commits"], limit=3).select("repo", "sha", "seq")


@register("com_commit_counts", ["commits", "commit_repos"], """
select r.full_name as repo, cast(coalesce(c.n, 0) as bigint) as commit_count
from (select distinct full_name from commit_repos) r
left join (select repo, count(*) as n from commits where message <> '' group by repo) c on c.repo = r.full_name
""")
def q_commit_counts(i):
    """COM2: commits with a non-empty subject per repository (0 if none)."""
    c = i["commits"].filter(F.col("message") != "")
    return com.commit_counts(c, i["commit_repos"])


@register("com_records", ["commits"], _REC + """
select repo, sha, parent_sha, files_changed, additions, deletions, is_root from rec
""")
def q_records(i):
    """COM3-COM5, COM8: full commit records (files, stats, root flag)."""
    return com.full_records(i["commits"]).select(
        "repo", "sha", "parent_sha", "files_changed", "additions", "deletions", "is_root")


@register("com_curated", ["commits", "commit_repos"], _REC + """
select c.repo, c.sha, cast(len(c.files_changed) as int) as n_files, c.additions, c.deletions, r.language
from cur c left join commit_repos r on r.full_name = c.repo
""")
def q_curated(i):
    """COM6, COM7, COM11, COM12: curated corpus with repository language."""
    df = com.curate(i["commits"], i["commit_repos"], CFG)
    return df.select("repo", "sha", F.size("files_changed").alias("n_files"), "additions", "deletions", "language")


@register("com_merge_dropped", ["commits"], _REC + """
select count(*) as merges_dropped from rec
where length(regexp_replace(message, '^\\s+|\\s+$', '', 'g')) >= 10
  and len(files_changed) <= 20 and octet_length(encode(diff)) <= 100000
  and starts_with(lower(message), 'merge ')
""")
def q_merge_dropped(i):
    """COM7: merge commits removed after the quality filter."""
    recs = com.quality_filter(com.full_records(i["commits"]), CFG)
    return recs.filter(com.is_merge(F.col("message"))).agg(F.count(F.lit(1)).alias("merges_dropped"))


@register("com_file_states", ["commits", "blobs"], _REC + """
select r.repo, r.sha, 'after' as side, b.path, b.content
from (select repo, sha, unnest(files_changed) as path from cur) r
join blobs b on b.repo = r.repo and b.sha = r.sha and b.path = r.path
union
select r.repo, r.sha, 'before' as side, b.path, b.content
from (select repo, sha, parent_sha, unnest(files_changed) as path from cur where parent_sha is not null) r
join blobs b on b.repo = r.repo and b.sha = r.parent_sha and b.path = r.path
""")
def q_file_states(i):
    """COM9: before/after state maps of curated commits, exploded for compare."""
    recs = com.curate(i["commits"], None, CFG)
    st = com.file_states(recs, i["blobs"])
    after = st.select("repo", "sha", F.lit("after").alias("side"), F.explode("child_files").alias("path", "content"))
    before = st.select("repo", "sha", F.lit("before").alias("side"),
                       F.explode("parent_files").alias("path", "content"))
    return after.unionByName(before).distinct()


@register("src_files_at_parent", ["commits", "blobs"], _REC + """
select w.repo, w.sha, w.path, b.content
from (select distinct repo, parent_sha as sha, unnest(files_changed) as path from rec where parent_sha is not null) w
left join blobs b on b.repo = w.repo and b.sha = w.sha and b.path = w.path
""")
def q_files_at_parent(i):
    """SRC5: content of every changed file of each commit at its parent."""
    recs = com.full_records(i["commits"]).filter(F.col("parent_sha").isNotNull())
    wanted = recs.select("repo", F.col("parent_sha").alias("sha"), F.explode("files_changed").alias("path")).distinct()
    return com.file_at(i["blobs"], wanted)


@register("com_shuffled", ["commits"], """
select repo, sha, md5(concat('11', ':', repo)) as repo_key,
  row_number() over (partition by repo order by md5(concat('11', ':', sha)), sha) as position
from commits
""")
def q_shuffled(i):
    """COM10: seeded repository keys and in-repository commit positions."""
    cfg = com.CommitFilter(shuffle_repos=True, shuffle_commits=True, seed=11)
    return com.shuffled_order(i["commits"], cfg).select("repo", "sha", "repo_key", "position")


@register("snk_export", ["commits", "commit_repos", "blobs"], _REC + """
, st as (select repo, sha,
    count(*) filter (where side = 'before') as n_before, count(*) filter (where side = 'after') as n_after from (
  select r.repo, r.sha, 'after' as side, b.path from (select repo, sha, unnest(files_changed) as path from cur) r
  join blobs b on b.repo = r.repo and b.sha = r.sha and b.path = r.path
  union
  select r.repo, r.sha, 'before' as side, b.path
  from (select repo, sha, parent_sha, unnest(files_changed) as path from cur where parent_sha is not null) r
  join blobs b on b.repo = r.repo and b.sha = r.parent_sha and b.path = r.path) x group by repo, sha)
select c.repo, c.sha, c.parent_sha, c.message, c.author, p.language, c.files_changed, c.additions, c.deletions,
  nullif(coalesce(st.n_before, 0), 0) as n_before_state, nullif(coalesce(st.n_after, 0), 0) as n_after_state
from cur c left join commit_repos p on p.full_name = c.repo left join st on st.repo = c.repo and st.sha = c.sha
""")
def q_export(i):
    """SNK3: training rows; empty state maps omitted (sizes shown here)."""
    recs = com.curate(i["commits"], i["commit_repos"], CFG)
    ex = com.to_export(com.file_states(recs, i["blobs"]))
    return ex.select("repo", "sha", "parent_sha", "message", "author", "language", "files_changed",
                     "additions", "deletions", F.size("before_state").alias("n_before_state"),
                     F.size("after_state").alias("n_after_state")) \
        .withColumn("n_before_state", F.when(F.col("n_before_state") > 0, F.col("n_before_state")).cast("bigint")) \
        .withColumn("n_after_state", F.when(F.col("n_after_state") > 0, F.col("n_after_state")).cast("bigint"))


@register("com_training_subset", ["commits"], _REC + """
select repo, sha from rec where len(files_changed) = 1 and not contains(diff, 'rename from')
  and not contains(diff, 'Binary files') and len(string_split(diff, chr(10))) < 500
""")
def q_training_subset(i):
    """COM13: single-file, rename-free, binary-free commits under 500 lines."""
    return com.training_subset(com.full_records(i["commits"])).select("repo", "sha")


@register("com_prompt_variants", ["commits"], _REC + """
, p as (select repo, sha, message, coalesce(files_changed[1], '') as path,
    regexp_replace(message, '^\\s+|\\s+$', '', 'g') as m from cur)
select repo, sha, 'raw' as variant, concat('User: ', message) as prompt from p
union all select repo, sha, 'path_hint', concat('User: In `', path, '`: ', message) from p
union all select repo, sha, 'imperative', concat('User: Modify `', string_split(path, '/')[-1], '` to ',
  lower(substr(m, 1, 1)), substr(m, 2)) from p
""")
def q_prompt_variants(i):
    """COM14: three prompt formulations per curated commit."""
    return com.prompt_variants(com.curate(i["commits"], None, CFG))


def _word_counts(df):
    """A user transform over Arrow batches (mapInPandas)."""
    def run(it):
        for pdf in it:
            out = pdf[["repo", "sha"]].copy()
            out["message_words"] = pdf["message"].str.split().str.len().fillna(0).astype("int64")
            yield out

    return df.mapInPandas(run, "repo string, sha string, message_words long")


@register("udx_commit_transform", ["commits"], _REC + """
select repo, sha, cast(len(list_filter(regexp_split_to_array(trim(message), '\\s+'), lambda w: w <> '')) as bigint)
  as message_words from cur
""")
def q_commit_transform(i):
    """UDX1/COM11: the curated corpus with a user transform applied."""
    return com.curate(i["commits"], None, CFG, transform=_word_counts)


# what the edits of the fixture are, by counting: changed lines are unique, so a longest
# common subsequence of the two texts is exactly what was left alone
_EDITS = """
, t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos
        from documents)
, n as (select doc_id, count(*) as n_lines, count(*) filter (where doc_id % 11 = 0 or (pos * 7 + doc_id) % 5 = 0) as dropped,
          count(*) filter (where doc_id % 11 <> 0 and (pos * 7 + doc_id) % 5 <> 0 and (pos + doc_id) % 9 = 0) as edited
        from t group by doc_id)
, c as (select d.doc_id, concat('d/', d.doc_id) as repo, n.*, md5(concat('c', d.doc_id)) as child, md5(concat('p', d.doc_id)) as parent,
          d.doc_id % 11 <> 0 as has_parent, d.doc_id % 6 = 0 as gains, d.doc_id % 4 = 0 and d.doc_id % 11 <> 0 as loses, d.lang, d.source, d.text
        from documents d join n using (doc_id))
"""


@register("com_diffs", ["revisions"], _EDITS + """
select repo, child as sha, case when has_parent then parent end as parent_sha,
  list_concat(list_concat(case when loses then ['gone.txt'] else [] end, case when gains then ['new.txt'] else [] end),
              case when dropped + edited > 0 then ['text.txt'] else [] end) as files_changed,
  cast(dropped + edited + case when gains then 2 else 0 end as int) as additions,
  cast(edited + case when loses then 2 else 0 end as int) as deletions,
  case when not has_parent then concat(
    case when gains then concat('diff --git a/new.txt b/new.txt', chr(10), '--- /dev/null', chr(10), '+++ b/new.txt', chr(10), '@@ -0,0 +1,2 @@', chr(10),
                                '+', lang, chr(10), '+', source, chr(10)) else '' end,
    'diff --git a/text.txt b/text.txt', chr(10), '--- /dev/null', chr(10), '+++ b/text.txt', chr(10), '@@ -0,0 +1,', n_lines, ' @@', chr(10),
    '+', replace(coalesce(text, ''), chr(10), concat(chr(10), '+')), chr(10)) end as root_diff
from c
union all
select repo, parent, null, list_concat(case when loses then ['gone.txt'] else [] end, ['text.txt']),
  cast(n_lines - dropped + case when loses then 2 else 0 end as int), 0, '' from c where has_parent
""")
def q_diffs(i):
    """COM3-COM5 from blobs: files, additions, deletions and (for child roots) the whole diff text."""
    blobs = i["revisions"]
    commits = blobs.select("repo", "sha", "parent_sha").distinct()
    out = dif.commit_diffs(commits, blobs)
    whole = F.when(F.col("parent_sha").isNull(), F.when(F.col("sha") == F.md5(F.concat(F.lit("c"), F.substring("repo", 3, 30))), F.col("diff")).otherwise(""))
    return out.select("repo", "sha", "parent_sha", "files_changed", "additions", "deletions", whole.alias("root_diff"))


@register("evl_diff_similarity", ["revisions"], _EDITS + """
select lang, count(*) as n_diffs, round(avg(1.0 - (dropped + edited) / cast(n_lines as double)), 6) as similarity
from c where has_parent group by lang
""")
def q_diff_similarity(i):
    """EVL8: line edit similarity of whole texts (the parent stands for the generated one), per language."""
    r = i["revisions"].where(F.col("path") == "text.txt").select("repo", "sha", "parent_sha", "content")
    old = r.select("repo", F.col("sha").alias("parent_sha"), F.col("content").alias("generated"))
    lang = i["documents"].select(F.concat(F.lit("d/"), "doc_id").alias("repo"), "lang")
    pairs = r.where(F.col("parent_sha").isNotNull()).join(old, ["repo", "parent_sha"]).join(lang, "repo")
    s = dif.line_similarity(F.col("generated"), F.col("content"))
    return pairs.select("lang", s.alias("s")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_diffs"), F.round(F.avg("s"), 6).alias("similarity"))
