"""Commit curation (SRC3, SRC5, COM1-COM14, SNK3).

Commits arrive as tables (a ``git log`` text export, a commit table with the
diff text, a blob table); running git is outside the engine.  Everything is
partitioned by repository; no repository's history is held in a list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.ordering import seq_number


@dataclass(frozen=True)
class CommitFilter:
    """Default curation thresholds."""
    min_message_length: int = 10
    max_files: int = 20
    max_diff_bytes: int = 100_000
    skip_merges: bool = True
    per_repo_limit: int | None = None
    shuffle_repos: bool = True
    shuffle_commits: bool = False
    seed: int = 0


def parse_log_lines(lines: DataFrame, col: str = "log_line") -> tuple[DataFrame, DataFrame]:
    """SRC3: ``sha|parents|author|date|subject`` split on the first four bars.

    Returns ``(commits, rejects)``; lines with fewer than five fields are
    rejects.  The first listed parent is the first-parent link.
    """
    parts = F.split(F.col(col), r"\|", 5)
    p = lines.withColumn("_p", parts)
    ok = F.size("_p") >= 5
    parents = F.split(F.trim(F.col("_p")[1]), " ")
    good = p.filter(ok).select(
        *[c for c in lines.columns if c != col],
        F.col("_p")[0].alias("sha"),
        F.when(F.col("_p")[1] == "", F.lit(None)).otherwise(parents[0]).alias("parent_sha"),
        F.col("_p")[2].alias("author"),
        F.col("_p")[3].alias("authored_at"),
        # a malformed date (e.g. fields shifted by a bar in the author) gives NULL, not a failed job
        F.try_to_timestamp(F.col("_p")[3], F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).alias("authored_ts"),
        F.col("_p")[4].alias("message"))
    bad = p.filter(~ok).drop("_p")
    return good, bad


def first_parent_list(commits: DataFrame, limit: int | None = None,
                      repo: str = "repo", seq: str = "seq") -> DataFrame:
    """COM1: newest first per repository, optionally the newest ``limit``.

    ``row_number() <= limit`` is planned as a WindowGroupLimit (bounded
    rows per repository leave each map task)."""
    if not limit:
        return commits
    w = Window.partitionBy(repo).orderBy(F.col(seq).desc(), F.col("sha"))
    return commits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def commit_counts(commits: DataFrame, repos: DataFrame, repo: str = "repo") -> DataFrame:
    """COM2: commits per repository; repositories without rows count 0."""
    c = commits.groupBy(repo).agg(F.count(F.lit(1)).alias("commit_count"))
    return (repos.select(F.col("full_name").alias(repo)).distinct().join(c, repo, "left")
            .select(repo, F.coalesce("commit_count", F.lit(0)).cast("bigint").alias("commit_count")))


def changed_files(name_only: Column) -> Column:
    """COM3: file list from ``--name-only`` text (empty lines dropped)."""
    return F.filter(F.split(F.coalesce(name_only, F.lit("")), "\n"), lambda x: x != "")


def shortstat(stat: Column) -> tuple[Column, Column]:
    """COM4: additions / deletions from a ``--shortstat`` line, missing = 0."""
    def grab(word):
        v = F.regexp_extract(stat, r"(\d+) " + word, 1)
        return F.coalesce(F.nullif(v, F.lit("")).try_cast("int"), F.lit(0))
    return grab("insertion"), grab("deletion")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def quality_filter(df: DataFrame, cfg: CommitFilter = CommitFilter()) -> DataFrame:
    """COM6: trimmed message length, file count and diff byte size, cheap
    tests first (the file list and diff are only read for survivors)."""
    return (df.filter(F.length(_strip(F.col("message"))) >= cfg.min_message_length)
            .filter(F.size("files_changed") <= cfg.max_files)
            .filter(F.octet_length("diff") <= cfg.max_diff_bytes))


def is_merge(message: Column) -> Column:
    """COM7: merge commits are recognised by message prefix."""
    return F.lower(message).startswith("merge ")


def full_records(commits: DataFrame) -> DataFrame:
    """COM5 + COM8: the full commit record (files, stats, diff, root flag)."""
    adds, dels = shortstat(F.col("shortstat"))
    return commits.select(
        "repo", "sha", "parent_sha", "seq", "author", "message", "diff",
        changed_files(F.col("files_text")).alias("files_changed"),
        adds.alias("additions"), dels.alias("deletions"),
        F.col("parent_sha").isNull().alias("is_root"))


def file_states(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """COM9: before/after file-state maps per commit.  The parent side only
    when a parent exists; files missing at a revision are omitted.  Groups
    are one commit's files (bounded by the file-count filter)."""
    files = records.select("repo", "sha", "parent_sha", F.explode("files_changed").alias("path"))
    want = files.select("repo", "sha", "path", F.col("sha").alias("_rev"), F.lit("after").alias("side")).unionByName(
        files.filter(F.col("parent_sha").isNotNull()).select("repo", "sha", "path", F.col("parent_sha").alias("_rev"), F.lit("before").alias("side")))
    # contents are the large side: one join serves both revisions of a file
    held = blobs.select("repo", F.col("sha").alias("_rev"), "path", "content")
    both = want.join(held, ["repo", "_rev", "path"]).select("repo", "sha", "side", F.struct(F.col("path").alias("key"), F.col("content").alias("value")).alias("kv"))
    g = both.groupBy("repo", "sha").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(
            F.when(F.col("side") == "before", F.col("kv"))))).alias("parent_files"),
        F.map_from_entries(F.array_distinct(F.collect_list(
            F.when(F.col("side") == "after", F.col("kv"))))).alias("child_files"))
    return records.join(g, ["repo", "sha"], "left")


def file_at(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC5: file content at a revision for ``(repo, sha, path)`` requests."""
    return wanted.join(blobs, ["repo", "sha", "path"], "left").select("repo", "sha", "path", "content")


def shuffled_order(df: DataFrame, cfg: CommitFilter) -> DataFrame:
    """COM10: reproducible shuffles: repository order by ``md5(seed:repo)``,
    commit order inside a repository by ``md5(seed:sha)`` (or newest first)."""
    rkey = F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), F.col("repo")))
    ckey = F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), F.col("sha")))
    out = df.withColumn("repo_key", rkey if cfg.shuffle_repos else F.col("repo"))
    corder = [ckey, F.col("sha")] if cfg.shuffle_commits else [F.col("seq").desc(), F.col("sha")]
    # only the keys are ranged, numbered and checkpointed; whole rows (diffs) meet their number once
    numbers = seq_number(df.select("repo", "sha", "seq").distinct(), ["repo"], corder, name="position")
    return out.join(numbers.select("repo", "sha", "seq", "position"), ["repo", "sha", "seq"])


def attach_language(df: DataFrame, repos: DataFrame) -> DataFrame:
    """COM12: repository language onto commit rows (left join on name)."""
    return df.join(repos.select(F.col("full_name").alias("repo"), "language"), "repo", "left")


def curate(commits: DataFrame, repos: DataFrame | None = None, cfg: CommitFilter = CommitFilter(),
           transform=None) -> DataFrame:
    """COM11: the corpus job: limit per repo (before the filters, as in the
    reference), quality filter, merge filter, language, optional transform
    (a ``DataFrame -> DataFrame`` function)."""
    df = first_parent_list(commits, cfg.per_repo_limit)
    df = quality_filter(full_records(df), cfg)
    if cfg.skip_merges:
        df = df.filter(~is_merge(F.col("message")))
    if repos is not None:
        df = attach_language(df, repos)
    return transform(df) if transform else df


def to_export(df: DataFrame) -> DataFrame:
    """SNK3: training-row layout; empty state maps are omitted (NULL)."""
    cols = [F.col("repo"), "sha", "parent_sha", "message", "author",
            F.col("authored_at").alias("timestamp") if "authored_at" in df.columns else F.lit(None).alias("timestamp"),
            F.col("language") if "language" in df.columns else F.lit(None).cast("string").alias("language"),
            "files_changed", "additions", "deletions", "diff"]
    for src, dst in (("parent_files", "before_state"), ("child_files", "after_state")):
        if src in df.columns:
            cols.append(F.when(F.coalesce(F.size(src), F.lit(0)) > 0, F.col(src)).alias(dst))
    return df.select(*cols)


def training_subset(df: DataFrame, max_lines: int = 500) -> DataFrame:
    """COM13: single-file additions/modifications: no renames, no binary
    files, fewer than ``max_lines`` diff lines."""
    return df.filter((F.size("files_changed") == 1)
                     & ~F.col("diff").contains("rename from")
                     & ~F.col("diff").contains("Binary files")
                     & (F.size(F.split("diff", "\n")) < max_lines))


def prompt_variants(df: DataFrame) -> DataFrame:
    """COM14: three prompt formulations per commit (raw message, message with
    a file-path hint, imperative request) as rows."""
    path = F.coalesce(F.try_element_at(F.col("files_changed"), F.lit(1)), F.lit(""))
    leaf = F.element_at(F.split(path, "/"), -1)
    first = F.lower(F.substring(_strip(F.col("message")), 1, 1))
    rest = F.substring(_strip(F.col("message")), 2, 1 << 20)
    # fixed values: the wording of the three prompts
    variants = F.array(
        F.struct(F.lit("raw").alias("variant"), F.concat(F.lit("User: "), F.col("message")).alias("prompt")),
        F.struct(F.lit("path_hint").alias("variant"),
                 F.concat(F.lit("User: In `"), path, F.lit("`: "), F.col("message")).alias("prompt")),
        F.struct(F.lit("imperative").alias("variant"),
                 F.concat(F.lit("User: Modify `"), leaf, F.lit("` to "), first, rest).alias("prompt")))
    return df.select("repo", "sha", F.inline(variants))
