"""Line diffs of two revisions, from their contents (COM3-COM5, EVL8).

A text is its lines; equal lines are equal numbers.  What both texts begin and end
with is set aside and lines that only one side has are left out, since they match
nothing; the rest is compared bit-parallel, one machine-word operation for a word's
worth of lines.  :func:`matches` finds a longest common subsequence by halving (linear
space, always minimal), :func:`line_distance` the edit distance in lines.

Spark joins the revisions, and the diffs of a commit's files meet again per
commit.  Where only the distance counts, Python gets digests of the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = 3
#: characters of a line's digest
DIGEST = 64


def lines_of(text: str | None) -> list[str]:
    """Lines of a text; a null or empty text has none, and a last line break opens no further line."""
    if not text:
        return []
    return (text[:-1] if text.endswith("\n") else text).split("\n")


def _places(b: list) -> dict:
    """Bit mask of the places of each line in ``b``."""
    out: dict = {}
    for j, y in enumerate(b):
        out[y] = out.get(y, 0) | (1 << j)
    return out


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    every = (1 << len(b)) - 1
    place, v = _places(b), every
    for x in a:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & every
    zero = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)] == 0
    return np.concatenate([[0], np.cumsum(zero)])


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, ascending."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, k, j, n = stack.pop()
        while i < k and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            k, n = k - 1, n - 1
            out.append((k, n))
        both = set(a[i:k]) & set(b[j:n])
        x, y = [p for p in range(i, k) if a[p] in both], [q for q in range(j, n) if b[q] in both]
        if not x or not y:
            continue
        if len(x) == 1:
            out.append((x[0], next(q for q in y if b[q] == a[x[0]])))
            continue
        half = len(x) // 2
        left = _prefix_lengths([a[p] for p in x[:half]], [b[q] for q in y])
        right = _prefix_lengths([a[p] for p in reversed(x[half:])], [b[q] for q in reversed(y)])[::-1]
        cut = int((left + right).argmax())
        middle = y[cut] if cut < len(y) else n
        stack += [(i, x[half], j, middle), (x[half], k, middle, n)]
    return sorted(out)


def line_distance(a: list, b: list) -> int:
    """Least number of inserted, deleted or replaced lines, bit-parallel over ``b``."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin:len(a) - end], b[begin:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    every, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    place, score = _places(b), len(b)
    up, down = every, 0  # columns where the score rises or falls by one
    for x in a:
        eq = place.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rises, falls = down | (every & ~(diagonal | up)), up & diagonal
        score += bool(rises & top) - bool(falls & top)
        rises, falls = ((rises << 1) | 1) & every, (falls << 1) & every
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal
    return score


def unified(path: str, old: str | None, new: str | None, context: int = CONTEXT) -> tuple[str, int, int]:
    """``(diff text, additions, deletions)`` of one file; a null side does not exist."""
    a, b = lines_of(old), lines_of(new)
    pairs = matches(a, b) if a and b else []
    added, removed = len(b) - len(pairs), len(a) - len(pairs)
    if not added and not removed:
        return "", 0, 0
    head = [f"diff --git a/{path} b/{path}", "--- " + (f"a/{path}" if old is not None else "/dev/null"),
            "+++ " + (f"b/{path}" if new is not None else "/dev/null")]
    # stretches without a match: (first old, end old, first new, end new)
    gaps, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        if p > i or q > j:
            gaps.append((i, p, j, q))
        i, j = p + 1, q + 1
    hunks: list[list[tuple[int, int, int, int]]] = []
    for g in gaps:
        if hunks and g[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(g)
        else:
            hunks.append([g])
    for h in hunks:
        before, after = min(context, h[0][0]), min(context, len(a) - h[-1][1])
        i, k, j, n = h[0][0] - before, h[-1][1] + after, h[0][2] - before, h[-1][3] + after
        head.append(f"@@ -{i + (k > i)},{k - i} +{j + (n > j)},{n - j} @@")
        for g in h:
            head += [" " + x for x in a[i:g[0]]] + ["-" + x for x in a[g[0]:g[1]]] + ["+" + x for x in b[g[2]:g[3]]]
            i = g[1]
        head += [" " + x for x in a[i:k]]
    return "\n".join(head) + "\n", added, removed


def two_sides(commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """COM9: ``repo, sha, path, old, new`` of every path that a commit or its parent holds.

    Contents are larger than anything else here, so each is moved once: a revision is
    wanted by its own commit as ``new`` and by its children as ``old``, and one join of the
    wanted (repo, revision) pairs with the blobs serves both."""
    want = commits.select("repo", "sha", F.col("sha").alias("_rev"), F.lit(True).alias("_own")).unionByName(
        commits.where(F.col("parent_sha").isNotNull()).select("repo", "sha", F.col("parent_sha").alias("_rev"), F.lit(False).alias("_own")))
    held = blobs.select("repo", F.col("sha").alias("_rev"), "path", "content")
    both = want.join(held, ["repo", "_rev"])
    return both.groupBy("repo", "sha", "path").agg(
        F.max(F.when(~F.col("_own"), F.col("content"))).alias("old"), F.max(F.when(F.col("_own"), F.col("content"))).alias("new"))


def file_diffs(sides: DataFrame) -> DataFrame:
    """COM4 + COM5 per file: ``repo, sha, path, diff, additions, deletions`` of the changed files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [unified(*row) for row in zip(b["path"], b["old"], b["new"])]
            yield b[["repo", "sha", "path"]].assign(
                diff=pd.Series([g[0] for g in got], b.index, dtype=object), additions=[g[1] for g in got], deletions=[g[2] for g in got])

    changed = sides.where(~F.col("old").eqNullSafe(F.col("new")))
    return changed.mapInPandas(run, "repo string, sha string, path string, diff string, additions int, deletions int")


def commit_diffs(commits: DataFrame, blobs: DataFrame) -> DataFrame:
    """COM3-COM5 from contents: ``repo, sha, files_changed, additions, deletions, diff`` of every
    commit; root commits are compared with the empty tree, so all their files are new."""
    files = file_diffs(two_sides(commits, blobs))
    per = files.groupBy("repo", "sha").agg(
        F.sort_array(F.collect_list(F.struct("path", "diff"))).alias("f"), F.sum("additions").cast("int").alias("additions"),
        F.sum("deletions").cast("int").alias("deletions"))
    none = F.array().cast("array<string>")
    return commits.select("repo", "sha", "parent_sha").join(per, ["repo", "sha"], "left").select(
        "repo", "sha", "parent_sha", F.coalesce(F.col("f.path"), none).alias("files_changed"),
        F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"),
        F.array_join(F.coalesce(F.col("f.diff"), none), "").alias("diff"))


def _line_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([line_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def line_names(text: Column) -> Column:
    """:func:`lines_of` with long lines named by their SHA-256: names are equal where lines are, and
    no short line looks like a digest."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, "\n")
    lines = F.when(t == "", F.array().cast("array<string>")).when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(lines, lambda x: F.when(F.octet_length(x) < DIGEST, x).otherwise(F.sha2(x, 256)))


def line_similarity(a: Column, b: Column) -> Column:
    """EVL8: ``1 - line edit distance / lines of the longer text`` (1 for two empty texts).

    Python gets the names of the lines, never the texts."""
    a, b = line_names(a), line_names(b)
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.pandas_udf(_line_distances, T.IntegerType())(a, b) / longer)
