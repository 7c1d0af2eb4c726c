"""Stand-in inputs derived from the driver's tables.

Each fixture only reshapes driver rows into the schema an operator expects
(catalog rows, status events, commits, ...); none of them does an operator's
work.  A fixture is SQL text with ``{name}`` placeholders for the tables or
fixtures it reads.  Spark runs it through ``spark.sql(text, **frames)``; the
oracle inlines the same (or a dialect twin) text as a CTE for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusflow.sources.tables import TABLES, table


@dataclass(frozen=True)
class Fixture:
    name: str
    spark_sql: str
    duck_sql: str
    deps: tuple


def _fx(name, deps, spark_sql, duck_sql=None):
    return Fixture(name, spark_sql, duck_sql or spark_sql, tuple(deps))


_CATALOG_COMMON = """
select doc_id as id, concat(source, '/r', cast(doc_id as string)) as full_name,
  source as owner, concat('r', cast(doc_id as string)) as name,
  cast((doc_id * 7919) % 120000 as int) as stars,
  case when doc_id % 17 = 0 then null else lang end as language,
  case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'mit' else 'apache-2.0' end as license_key,
  case when doc_id % 23 = 0 then null else n_chars end as size_kb,
  case when doc_id % 29 = 0 then null else 'main' end as default_branch,
  doc_id % 10 = 3 as fork, doc_id % 13 = 5 as archived,
  case cast(doc_id % 6 as int) when 0 then 'pending' when 1 then 'downloading' when 2 then 'downloaded'
    when 3 then 'processing' when 4 then 'processed' else 'failed' end as status,
  case when doc_id % 6 in (2, 4) then n_chars * 1024 end as actual_size_bytes,
  case when doc_id % 6 = 4 then doc_id % 500 end as commit_count,
  case when doc_id % 6 = 5 then cast(doc_id % 5 as int) else 0 end as failure_count,
  case when doc_id % 6 in (2, 3, 4) and doc_id % 7 <> 0
    then concat('/data/repos/', source, '/r', cast(doc_id as string)) end as local_path,
  case when doc_id % 6 = 5 then concat('error ', cast(doc_id % 8 as string)) end as last_error,
  case when doc_id % 11 = 0 then null
    else date '2024-01-01' + cast(doc_id % 90 as int) end as metadata_updated_on,
  {started} as download_started_at
from {{documents}}
"""

_STARTED_SPARK = ("case when doc_id % 6 = 1 and doc_id % 19 <> 0 then timestamp_ntz '2024-03-31 00:00:00'"
                  " - make_dt_interval(0, 0, cast(doc_id % 300 as int), 0) end")
_STARTED_DUCK = ("case when doc_id % 6 = 1 and doc_id % 19 <> 0 then timestamp '2024-03-31 00:00:00'"
                 " - to_minutes(cast(doc_id % 300 as int)) end")

REPO_CATALOG = _fx(
    "repo_catalog", ["documents"],
    _CATALOG_COMMON.format(started=_STARTED_SPARK),
    _CATALOG_COMMON.format(started=_STARTED_DUCK),
)

REPO_EVENTS = _fx("repo_events", ["events"], """
select event_id, ts, concat('u/', cast(user_id as string)) as full_name,
  case event_type when 'signup' then 'discovered' when 'click' then 'downloading'
    when 'purchase' then 'downloaded' when 'view' then 'processed' else 'failed' end as action,
  value
from {events}
""")

# A discovery batch: every document yields one raw repository row; a quarter
# reuse catalog names (updates), the rest collide on purpose (in-batch dups).
DISCOVERED_BATCH = _fx("discovered_batch", ["documents"], """
select doc_id as arrival,
  case when doc_id % 4 = 0 then concat(source, '/r', cast(doc_id as string))
       else concat(lang, '/x', cast(n_chars % 499 as string)) end as full_name,
  cast((n_chars * 31) % 90000 as int) as stars,
  case when doc_id % 9 = 0 then null else lang end as language,
  case when doc_id % 3 = 0 then 'mit' end as license_key,
  cast(n_chars % 70000 as bigint) as size_kb,
  'main' as default_branch, doc_id % 8 = 1 as fork, false as archived
from {documents}
""")

# Fresh metadata as the remote API returns it: JSON text with a nested
# license object; fields are missing in some rows.
RAW_REPO_JSON = _fx("raw_repo_json", ["documents"], """
select doc_id as arrival, concat('{{"id": ', cast(doc_id as string),
  ', "full_name": "', case when doc_id % 10 = 7 then upper(source) else source end, '/r', cast(doc_id as string),
  case when doc_id % 15 = 2 then '-moved' else '' end, '"',
  ', "stargazers_count": ', cast((doc_id * 7919) % 120000 as string),
  case when doc_id % 17 = 0 then ', "language": null' else concat(', "language": "',
    case lang when 'en' then 'Python' when 'fr' then 'Haskell' when 'de' then 'Zig' else 'Rust' end, '"') end,
  case when doc_id % 5 = 0 then ', "license": null' else concat(', "license": {{"key": "', case when doc_id % 5 = 1 then 'mit' else 'apache-2.0' end, '"}}') end,
  case when doc_id % 23 = 0 then '' else concat(', "size": ', cast(n_chars as string)) end,
  case when doc_id % 29 = 0 then '' else ', "default_branch": "main"' end,
  ', "fork": ', case when doc_id % 10 = 3 then 'true' else 'false' end,
  case when doc_id % 13 = 5 then ', "archived": true' else '' end,
  ', "created_at": "2023-0', cast(1 + doc_id % 9 as string), '-1', cast(doc_id % 10 as string), 'T08:30:00Z"',
  ', "updated_at": "2024-03-', cast(10 + doc_id % 20 as string), 'T12:00:00Z"}}') as value
from {documents}
where doc_id % 31 <> 4
""")

_COMMITS = """
select concat('c/', cast(conv_id as string)) as repo,
  md5(concat(cast(conv_id as string), ':', cast(turn as string))) as sha,
  case when turn = 0 then null
    else md5(concat(cast(conv_id as string), ':', cast(turn - 1 as string))) end as parent_sha,
  turn as seq, role as author,
  case when turn % 4 = 3 then concat('Merge branch ', split_part(text, chr(10), 1))
    else split_part(text, chr(10), 1) end as message,
  cast(length(text) % 25 as int) as n_files, text as diff,
  {files} as files_text,
  concat(' ', cast(length(text) % 25 as string), ' file', case when length(text) % 25 = 1 then '' else 's' end, ' changed',
    case when turn % 5 = 0 then '' else concat(', ', cast(length(text) % 97 as string), ' insertion',
      case when length(text) % 97 = 1 then '' else 's' end, '(+)') end,
    case when turn % 3 = 0 then '' else concat(', ', cast(length(text) % 13 as string), ' deletion',
      case when length(text) % 13 = 1 then '' else 's' end, '(-)') end) as shortstat,
  concat(md5(concat(cast(conv_id as string), ':', cast(turn as string))), '|',
    case when turn = 0 then '' else md5(concat(cast(conv_id as string), ':', cast(turn - 1 as string))) end, '|',
    case when conv_id % 9 = 0 then concat(role, '|bot') else role end, '|',
    '2024-02-', cast(10 + turn as string), 'T09:00:00+01:00', '|',
    split_part(text, chr(10), 1)) as log_line
from {{conversations}}
"""
COMMITS = _fx(
    "commits", ["conversations"],
    _COMMITS.format(files="array_join(slice(split(text, ' '), 1, cast(length(text) % 25 as int)), chr(10))"),
    _COMMITS.format(files="array_to_string(string_split(text, ' ')[1:cast(length(text) % 25 as int)], chr(10))"),
)

# Status events aimed at the catalog: two thirds of the users map onto an
# existing catalog row (updates), the rest onto fresh names (inserted by their
# first 'discovered' event).
TRANSITION_EVENTS = _fx("transition_events", ["events", "documents"], """
select e.event_id, e.ts,
  case when e.user_id % 3 = 0 or d.doc_id is null then concat('u/', cast(e.user_id as string))
       else concat(d.source, '/r', cast(d.doc_id as string)) end as full_name,
  case e.event_type when 'signup' then 'discovered' when 'click' then 'downloading'
    when 'purchase' then 'downloaded' when 'view' then case when e.event_id % 3 = 0 then 'processing' else 'processed' end
    else 'failed' end as action,
  case when e.event_type = 'error' then concat('error at ', cast(e.event_id % 8 as string)) end as error,
  case when e.event_type = 'purchase' then cast(floor(e.value * 1000) as bigint) end as size_bytes,
  case when e.event_type = 'purchase' then concat('/data/repos/u', cast(e.user_id as string)) end as path,
  case when e.event_type = 'view' and e.event_id % 3 <> 0 then cast(floor(e.value) as bigint) end as commit_count
from {events} e left join {documents} d on d.doc_id = e.user_id
""")

# Blob table: content of each changed file at the commit, and (for two
# thirds of the paths) at the parent commit.
BLOBS = _fx("blobs", ["commits"], """
select distinct repo, sha, path, content from (
  select repo, sha, path, concat('v:', substr(sha, 1, 8), ':', path) as content
  from (select repo, sha, path from {commits} lateral view explode(split(files_text, chr(10))) t as path) a
  where path <> ''
  union all
  select repo, parent_sha as sha, path, concat('v:', substr(parent_sha, 1, 8), ':', path) as content
  from (select repo, parent_sha, path from {commits} lateral view explode(split(files_text, chr(10))) t as path) b
  where path <> '' and parent_sha is not null and length(path) % 3 <> 0) u
""", """
select distinct repo, sha, path, content from (
  select repo, sha, path, concat('v:', substr(sha, 1, 8), ':', path) as content
  from (select repo, sha, unnest(string_split(files_text, chr(10))) as path from {commits}) a
  where path <> ''
  union all
  select repo, parent_sha as sha, path, concat('v:', substr(parent_sha, 1, 8), ':', path) as content
  from (select repo, parent_sha, unnest(string_split(files_text, chr(10))) as path from {commits}) b
  where path <> '' and parent_sha is not null and length(path) % 3 <> 0) u
""")

# Repository dimension of the commit corpus (language from the document of
# the same id; conversations without one have no language).
COMMIT_REPOS = _fx("commit_repos", ["conversations", "documents"], """
select distinct concat('c/', cast(c.conv_id as string)) as full_name, d.lang as language
from {conversations} c left join {documents} d on d.doc_id = c.conv_id
""")

# Memory store entries: one per document, addressed by a path-like id.
MEMORY_ENTRIES = _fx("memory_entries", ["documents"], """
select doc_id, concat('/', source, '/', lang, '/', cast(doc_id as string), '.txt') as path,
  cast(1 as bigint) as version, n_chars, lang
from {documents}
""")

# Updates to the store: new versions for a third of the documents (twice
# for a sixth, the later version must win) and entries of new documents.
MEMORY_UPDATES = _fx("memory_updates", ["documents"], """
select doc_id, concat('/', source, '/', lang, '/', cast(doc_id as string), '.txt') as path,
  cast(2 as bigint) as version, n_chars + 1 as n_chars, lang from {documents} where doc_id % 3 = 0
union all
select doc_id, concat('/', source, '/', lang, '/', cast(doc_id as string), '.txt') as path,
  cast(3 as bigint) as version, n_chars + 2 as n_chars, lang from {documents} where doc_id % 6 = 0
union all
select doc_id + 1000000 as doc_id, concat('/new/', lang, '/', cast(doc_id as string), '.txt') as path,
  cast(1 as bigint) as version, n_chars, lang from {documents} where doc_id % 10 = 1
""")

# The corpus as it was at the previous refresh: some texts changed since,
# some documents are new since, some were deleted since.
DOCUMENTS_PREV = _fx("documents_prev", ["documents"], """
select doc_id, case when doc_id % 5 = 0 then concat(text, ' (earlier draft)') else text end as text
from {documents} where doc_id % 11 <> 0
union all
select doc_id + 1000000 as doc_id, text from {documents} where doc_id % 13 = 0
""")

# Retrieval memory from the embedding table: each label is one group
# (example); its vectors are the documents (value = reversed key), each
# document has four token vectors (the key rotated by 16 * position), and
# the group's query is the mean vector of its documents.
RET_DOCS = _fx("ret_docs", ["embeddings"], """
select label as group_id, vec_id as doc_id, cast(embedding as array<double>) as key,
  reverse(cast(embedding as array<double>)) as value from {embeddings}
""", """
select label as group_id, vec_id as doc_id, cast(embedding as double[]) as key,
  list_reverse(cast(embedding as double[])) as value from {embeddings}
""")
RET_TOKENS = _fx("ret_tokens", ["embeddings"], """
select label as group_id, vec_id as doc_id, tok_pos,
  concat(slice(cast(embedding as array<double>), 16 * tok_pos + 1, 64 - 16 * tok_pos),
         slice(cast(embedding as array<double>), 1, 16 * tok_pos)) as key,
  concat(slice(reverse(cast(embedding as array<double>)), 16 * tok_pos + 1, 64 - 16 * tok_pos),
         slice(reverse(cast(embedding as array<double>)), 1, 16 * tok_pos)) as value
from {embeddings} lateral view explode(sequence(0, 3)) t as tok_pos
""", """
select label as group_id, vec_id as doc_id, tok_pos,
  list_concat(cast(embedding as double[])[16 * tok_pos + 1 : 64], cast(embedding as double[])[1 : 16 * tok_pos]) as key,
  list_concat(list_reverse(cast(embedding as double[]))[16 * tok_pos + 1 : 64],
              list_reverse(cast(embedding as double[]))[1 : 16 * tok_pos]) as value
from {embeddings}, (select unnest(range(4)) as tok_pos) t
""")
RET_QUERIES = _fx("ret_queries", ["embeddings"], """
select group_id, cast(group_id as bigint) as query_id, 0 as pos,
  transform(array_sort(collect_list(struct(i, v))), x -> x.v) as q
from (select label as group_id, i, avg(cast(e as double)) as v
      from {embeddings} lateral view posexplode(embedding) t as i, e group by label, i) a
group by group_id
""", """
select group_id, cast(group_id as bigint) as query_id, 0 as pos, list(v order by i) as q
from (select label as group_id, i, avg(cast(e as double)) as v
      from (select label, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from {embeddings}) x
      group by label, i) a
group by group_id
""")

# Outcome log of download attempts: each 'failed' status event carries an
# error message, one text per branch of the classification ladder.
DOWNLOAD_LOG = _fx("download_log", ["repo_events"], """
select event_id, ts, full_name, action = 'downloaded' as success,
  case when action = 'downloaded' then cast(floor(value * 1000) as bigint) else 0 end as size_bytes,
  case when action <> 'failed' then null
       when event_id % 8 = 0 then 'fatal: repository not found'
       when event_id % 8 = 1 then 'HTTP 301 repository moved permanently'
       when event_id % 8 = 2 then 'Clone timeout after 300s'
       when event_id % 8 = 3 then 'fatal: could not read Username'
       when event_id % 8 = 4 then 'remote: Internal server error'
       when event_id % 8 = 5 then 'Remote branch does not exist'
       when event_id % 8 = 6 then 'SSL certificate problem'
       else 'unexpected disk quota exceeded' end as error
from {repo_events}
where action in ('downloaded', 'failed')
""")

# File inventory of the clone folder: one file per document line; repos of
# documents with doc_id % 7 = 3 have no files (missing clones).
FILE_INVENTORY = _fx("file_inventory", ["documents"], """
select concat('/data/repos/', source, '/r', cast(doc_id as string), '/f', cast(pos as string), '.txt') as path,
  cast(octet_length(line) as bigint) * 40000 as length
from (select doc_id, source, line, pos from {documents}
      lateral view posexplode(split(text, chr(10))) t as pos, line
      where doc_id % 7 <> 3)
""", """
select concat('/data/repos/', source, '/r', cast(doc_id as string), '/f', cast(pos as string), '.txt') as path,
  cast(octet_length(encode(line)) as bigint) * 40000 as length
from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
      from {documents} where doc_id % 7 <> 3)
""")

# Predictions to score: the expected answer is the greatest word of a whole text; the
# generated ones hold it, the whole text, or the text without it, so that each match rule
# (prefix, case, whole word, miss, empty) is met.  Only a-z change their case: engines differ in
# the capital of a sharp s.
_EVAL_PRED = """
with w as (select doc_id, lang, text, {greatest} as answer, {least} as other from {{documents}})
select doc_id as example_id, lang as category, 'with_memory' as variant,
  case when doc_id % 37 = 0 then '' else answer end as expected,
  case cast(doc_id % 5 as int)
    when 0 then concat(answer, ' and ', text)
    when 1 then translate(answer, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
    when 2 then text
    when 3 then other
    else concat('x', answer) end as generated
from w
union all
select doc_id as example_id, lang as category, 'without_memory' as variant,
  case when doc_id % 37 = 0 then '' else answer end as expected,
  case cast(doc_id % 3 as int)
    when 0 then concat(' ', answer, ' ')
    when 1 then replace(text, answer, '-')
    else concat('(', answer, ')') end as generated
from w where lang <> 'es'
"""
EVAL_PRED = _fx(
    "eval_pred", ["documents"],
    _EVAL_PRED.format(greatest="array_max(split(text, ' '))", least="array_min(array_remove(split(text, ' '), ''))"),
    _EVAL_PRED.format(greatest="list_max(string_split(text, ' '))",
                      least="list_min(list_filter(string_split(text, ' '), lambda x: x <> ''))"),
)

# Logged training metrics: five events make one step; the event type names
# the metric.
STEP_METRIC = _fx("step_metric", ["events"], """
select cast(day(ts) as int) as epoch, event_id div 5 as step,
  case event_type when 'click' then 'loss' when 'view' then 'gate_value' when 'purchase' then 'grad_norm'
    when 'signup' then 'learning_rate' else 'encoder_grad_norm' end as name,
  case event_type when 'click' then value / 50.0 when 'view' then (value - 50.0) / 500.0
    when 'purchase' then value / 10.0 when 'signup' then value / 1000000.0 else value / 100.0 end as value
from {events}
""", """
select cast(day(ts) as int) as epoch, event_id // 5 as step,
  case event_type when 'click' then 'loss' when 'view' then 'gate_value' when 'purchase' then 'grad_norm'
    when 'signup' then 'learning_rate' else 'encoder_grad_norm' end as name,
  case event_type when 'click' then value / 50.0 when 'view' then (value - 50.0) / 500.0
    when 'purchase' then value / 10.0 when 'signup' then value / 1000000.0 else value / 100.0 end as value
from {events}
""")

# Two revisions of every document as a repository of its own: the child holds the whole text,
# the parent an edited form of it (every fifth line missing, some lines changed); some
# repositories also lose or gain a small file, and every eleventh has no parent.
_REVISIONS = """
with l as ({lines}),
e as (select doc_id, pos, case when (pos + doc_id) % 9 = 0 then concat('edited ', cast(doc_id as string), ':', cast(pos as string)) else line end as line
      from l where (pos * 7 + doc_id) % 5 <> 0 and doc_id % 11 <> 0),
p as (select doc_id, concat({joined}, chr(10)) as content from e group by doc_id),
d as (select doc_id, lang, source, concat('d/', cast(doc_id as string)) as repo, md5(concat('c', cast(doc_id as string))) as child,
        md5(concat('p', cast(doc_id as string))) as parent, concat(coalesce(text, ''), chr(10)) as text from {{documents}})
select repo, child as sha, case when doc_id % 11 <> 0 then parent end as parent_sha, 'text.txt' as path, text as content from d
union all select repo, child, case when doc_id % 11 <> 0 then parent end, 'new.txt', concat(lang, chr(10), source, chr(10)) from d where doc_id % 6 = 0
union all select repo, parent, null, 'gone.txt', concat(source, chr(10), lang, chr(10)) from d where doc_id % 4 = 0 and doc_id % 11 <> 0
union all select d.repo, d.parent, null, 'text.txt', coalesce(p.content, '') from d left join p on p.doc_id = d.doc_id where d.doc_id % 11 <> 0
"""
REVISIONS = _fx(
    "revisions", ["documents"],
    _REVISIONS.format(lines="select doc_id, pos, line from {documents} lateral view posexplode(split(coalesce(text, ''), chr(10))) t as pos, line",
                      joined="array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), chr(10))"),
    _REVISIONS.format(lines="select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, "
                            "generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from {documents}",
                      joined="string_agg(line, chr(10) order by pos)"),
)

# A batch of renames over the catalog, by groups of eight neighbouring ids: a chain of three, a
# swap, a redirect over a name that is no row, and a move onto a row that stays.
RENAME_BATCH = _fx("rename_batch", ["repo_catalog"], """
select a.full_name as old_name, b.full_name as new_name from {repo_catalog} a join {repo_catalog} b
  on b.id = a.id + case when a.id % 8 = 4 then -1 else 1 end where a.id % 8 in (0, 1, 3, 4, 6)
union all select full_name, concat('moved/x', cast(id as string)) from {repo_catalog} where id % 8 = 2
union all select full_name, concat('gone/y', cast(id as string)) from {repo_catalog} where id % 8 = 5
union all select concat('gone/y', cast(id as string)), concat('final/z', cast(id as string)) from {repo_catalog} where id % 8 = 5
""")

FIXTURES = {f.name: f for f in (
    REVISIONS, RENAME_BATCH,
    REPO_CATALOG, REPO_EVENTS, TRANSITION_EVENTS, DISCOVERED_BATCH, RAW_REPO_JSON, COMMITS, BLOBS, COMMIT_REPOS, MEMORY_ENTRIES, MEMORY_UPDATES, DOCUMENTS_PREV, RET_DOCS, RET_TOKENS, RET_QUERIES, DOWNLOAD_LOG,
    FILE_INVENTORY, EVAL_PRED, STEP_METRIC,
)}


def fixture(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """Build fixture ``name`` (and its dependencies) as a Spark DataFrame."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    if name in TABLES:
        df = table(spark, sf_dir, name)
    else:
        fx = FIXTURES[name]
        frames = {d: fixture(spark, sf_dir, d, cache) for d in fx.deps}
        df = spark.sql(fx.spark_sql, **frames)
    cache[name] = df
    return df


def duck_ctes(*names: str) -> str:
    """``WITH`` clause defining the named fixtures (and dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n):
        if n in TABLES or n in order:
            return
        for d in FIXTURES[n].deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    parts = []
    for n in order:
        fx = FIXTURES[n]
        body = fx.duck_sql.format(**{d: d for d in fx.deps})
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
