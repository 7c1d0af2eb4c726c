"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct word shingles.  Equal sets are one node of
the join, so copies cost nothing further.  Independent random trees branch the
documents: a tree node picks one or two minwise coordinates (on average 1 /
threshold, as the chosen-path method does) and sends each document to the child
named by its minimal shingle there.  Small nodes are compared exhaustively, larger
ones branch on.  A pair at the threshold stays together in one tree with
probability ``p(depth)``, and :func:`trees_for` repeats trees until the target
recall is met at ``RECALL_DEPTH``.  Where nodes branch deeper, their members get
the trees that the depth reached asks for, with the labels found so far.

Nodes of at most ``NODE`` documents are joined with themselves over sketches, and
what passes is confirmed on the full sets.  In nodes of at most ``GROUP`` documents and
``SHINGLES`` shingles, one task sorts out by sketches who has a possible partner at all,
and only those are compared by their full sets.  Only beyond that
a node branches.  Groups of near copies never become small by branching, since
all their members choose the same shingles.  So a large node first compares all
members with ``PIVOTS`` of them, in two turns: every label with its closest pivot, then what
still has two labels.  Links are confirmed on the full sets; linked
members share a label, the pivots leave (all their links here are known), and a
node whose members have one label is done: whatever links are left in it join
what is joined already.  No pair with two labels is skipped, so components lose
nothing.

Trees are worked off in ``ROUNDS``: the first tree finds most links, so the nodes of the later
ones mostly hold one label and are dropped before a text is moved.

Candidates pass a one-bit minwise sketch of 128 bits first (five standard
deviations below the threshold).  Candidate pairs of small nodes are confirmed
in two turns: each document with its least candidate partner, then only pairs
that the first turn has not connected.  Texts are fetched once, for candidate
documents alone, and kept as packed sets (the bytes of their sorted shingles), dealt by id into
buckets of about ``BUCKET`` bytes: later steps take no text apart again, and few tasks ask for a Python worker.
Workers remember no words: the collector goes over whatever a worker holds after every task.
Every step is an equi-join or an aggregate; a hot node is
joined with few rows, so AQE may split it.  Steps are cut by tables in the shared
folder.  Nodes still large after ``MAX_DEPTH`` levels are joined on their rarest
shingles: sets at the threshold share one of the first ``n - ceil(threshold * n) + 1`` in any order, so
nothing is lost, and what all members share is hardly ever joined on.  So are nodes that do not
shrink by branching (a child keeps more than ``STALL`` of its parent: copies with many
edits, which choose the same shingles and are yet no links).  Their members get the node as a tag, and pairs
with one tag are not looked at again in other trees.

Components are found by alternating large and small stars over the links.

Defined cases: null text or one without words has no set, is linked with nothing
and is kept as its own component; repeated rows are one set; a null ``doc_id`` is
no candidate for the least id unless all ids of the component are null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.common import keep, keep_dealt

POOL = 128
NODE = 64
GROUP = 2_000
SHINGLES = 2_000_000
PIVOTS = 8
MAX_DEPTH = 16
STALL = 0.5
#: bytes of packed sets in a bucket
BUCKET = 16 * 1024 * 1024
#: trees worked off together: the first, the next two, all others
ROUNDS = (1, 3)
RECALL = 0.99999
RECALL_DEPTH = 3
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: odd multipliers: one minwise coordinate each
_MULT = np.random.default_rng(20240917).integers(0, 2**63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; A-Z lower-cased, words between
    ASCII white space; fewer words than ``width`` are one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = total * _M1 + h[j:len(h) - k + 1 + j]
    s = np.sort(mix(total))
    return s[np.append(True, s[1:] != s[:-1])]


def unpack(held: str | bytes, width: int) -> np.ndarray:
    """The set of a text, or of the bytes of its shingles."""
    return shingles(held, width) if isinstance(held, str) else np.frombuffer(held, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The minimal value of the set in each coordinate of the pool."""
    if len(s) <= 4096:
        return (s[None, :] * _MULT[:, None]).min(1)
    return np.array([(s * m).min() for m in _MULT], np.uint64)


def bits(low: np.ndarray) -> tuple[int, int]:
    """One bit of each coordinate, as two signed longs."""
    b = np.packbits(((low >> np.uint64(17)) & np.uint64(1)).astype(bool)).view(">i8")
    return int(b[0]), int(b[1])


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a node at ``depth`` of a tree."""
    p, second = 1.0, 1 / threshold - 1
    for _ in range(depth):
        p = 1 - (1 - threshold * p) * (1 - second * threshold * p)
    return p


def trees_for(threshold: float, recall: float = RECALL, depth: int | None = None) -> int:
    """Trees that find a pair at the threshold when no node is deeper than ``depth``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, RECALL_DEPTH if depth is None else depth)))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def chosen(nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates that nodes branch on: first, second, and whether there is a second."""
    h = mix(nodes + np.uint64(0x51ED270B))
    first = h % np.uint64(POOL)
    second = (first + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(POOL - 1)) % np.uint64(POOL)
    return first.astype(int), second.astype(int), _unit(mix(h + np.uint64(7))) < 1 / threshold - 1


def child(node: np.ndarray, coordinate: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(node * _M2 + coordinate.astype(np.uint64)) ^ low)


def roots(trees: int, threshold: float) -> list[tuple[int, int]]:
    """``(tree, coordinate)`` of the first branching; trees share no coordinate."""
    order = np.random.default_rng(7).permutation(POOL)
    out, at = [], 0
    for t in range(trees):
        n = 2 if (t * (1 / threshold - 1)) % 1 + (1 / threshold - 1) >= 1 else 1
        out += [(t, int(order[(at + i) % POOL])) for i in range(n)]
        at += n
    return out


def sketch(docs: DataFrame, width: int, threshold: float, trees: int) -> DataFrame:
    """``doc_id, text_hash, id, n, b0, b1, nodes``: the set's digest and size, its
    bits and first nodes."""
    first = roots(trees, threshold)
    tree = np.array([t for t, _ in first], np.uint64)
    coordinate = np.array([c for _, c in first])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text, width)
                if not len(s):
                    rows.append((None, 0, 0, 0, None))
                    continue
                low = minima(s)
                nodes = child(tree, coordinate, low[coordinate]).astype(np.int64)
                rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), *bits(low), nodes))
            out = pd.DataFrame(rows, columns=["id", "n", "b0", "b1", "nodes"])
            out.insert(0, "text_hash", b["text_hash"].to_numpy())
            out.insert(0, "key", b["key"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
        run, "key string, text_hash bigint, id binary, n bigint, b0 bigint, b1 bigint, nodes array<bigint>")
    return rows.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).drop("key")


def _differ(x: str, y: str) -> Column:
    return F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))) + F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1")))


def _close(threshold: float, x: str, y: str) -> Column:
    """Sizes allow the threshold, and the bits do not rule it out."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= round(100 * threshold) * F.greatest(n, m)) & (_differ(x, y) <= _most_differing(threshold))


def _apart(x: str, y: str) -> Column:
    """Two labels, and not yet compared in one node."""
    return (F.col(f"{x}.label") != F.col(f"{y}.label")) & F.coalesce(F.col(f"{x}.tag") != F.col(f"{y}.tag"), F.lit(True))


def _most_differing(threshold: float) -> int:
    """Sketch bits in which sets at the threshold may differ: five standard deviations."""
    same = (1 + threshold) / 2
    return math.floor(POOL * (1 - same) + 5 * math.sqrt(POOL * same * (1 - same)))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def confirm(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold; ``sets`` has an id with its packed set or its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.zeros(len(b), bool)
            for k, (i, j) in enumerate(zip(b["sa"], b["sb"])):
                x, y = unpack(i, width), unpack(j, width)
                short, long = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                both = int((long[at] == short).sum())
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.loc[ok, ["a", "b"]]

    held = next(c for c in sets.columns if c != "id")
    a = sets.select(F.col("id").alias("a"), F.col(held).alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col(held).alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary")


def branch(rows: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The rows of large nodes in their children, with the size of the parent (``held``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            node = b["node"].to_numpy(np.int64).astype(np.uint64)
            own = [np.frombuffer(x, np.uint64) for x in b["packed"]]
            first, second, two = chosen(node, threshold)
            low1 = np.array([(s * _MULT[c]).min() for s, c in zip(own, first)], np.uint64)
            low2 = np.array([(s * _MULT[c]).min() if t else 0 for s, c, t in zip(own, second, two)], np.uint64)
            out = b[["id", "n", "b0", "b1", "label", "tag", "held"]]
            again = out[two].assign(node=child(node, second, low2).astype(np.int64)[two])
            out = out.assign(node=child(node, first, low1).astype(np.int64))
            yield pd.concat([out, again])[["node", "id", "n", "b0", "b1", "label", "tag", "held"]]

    return rows.join(packed, "id").select("node", "id", "n", "b0", "b1", "label", "tag", F.col("size").alias("held"), "packed").mapInPandas(
        run, "node bigint, id binary, n bigint, b0 bigint, b1 bigint, label binary, tag string, held bigint")


def more_trees(rows: DataFrame, packed: DataFrame, threshold: float, begin: int, trees: int) -> DataFrame:
    """The rows in the first nodes of the trees from ``begin`` on."""
    first = roots(trees, threshold)
    tree = np.array([t for t, _ in first if t >= begin], np.uint64)
    coordinate = np.array([c for t, c in first if t >= begin])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes = []
            for x in b["packed"]:
                s = np.frombuffer(x, np.uint64)
                nodes.append(child(tree, coordinate, np.array([(s * m).min() for m in _MULT[coordinate]], np.uint64)).astype(np.int64))
            yield b.drop(columns="packed").assign(nodes=nodes)

    out = rows.join(packed, "id").select("id", "n", "b0", "b1", "label", "tag", "packed").mapInPandas(
        run, "id binary, n bigint, b0 bigint, b1 bigint, label binary, tag string, nodes array<bigint>")
    return out.select(F.explode("nodes").alias("node"), "id", "n", "b0", "b1", "label", "tag")


def _small_pairs(rows: DataFrame, threshold: float, labelled: bool) -> DataFrame:
    """Candidate pairs of small nodes: an equi-join of nodes of at most NODE rows."""
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.node") == F.col("y.node")) & (F.col("x.id") < F.col("y.id")) & _close(threshold, "x", "y")
    if labelled:
        on = on & _apart("x", "y")
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def close_members(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of middle nodes that have a possible partner with another label, by their sketches."""
    percent, most = round(100 * threshold), _most_differing(threshold)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        n, bits_ = b["n"].to_numpy(np.int64), b[["b0", "b1"]].to_numpy(np.int64).view(np.uint64)
        label, tag = pd.factorize(b["label"])[0], pd.factorize(b["tag"])[0]  # no tag: -1
        keep_ = np.zeros(len(b), bool)
        for i in range(0, len(b), 256):
            own = slice(i, i + 256)
            differ = sum(np.bitwise_count(bits_[own, None, k] ^ bits_[None, :, k]) for k in (0, 1))
            small, large = np.minimum(n[own, None], n), np.maximum(n[own, None], n)
            near = (differ <= most) & (100 * small >= percent * large) & (label[own, None] != label)
            near &= (tag[own, None] < 0) | (tag[own, None] != tag)
            keep_[own] = near.any(1)
        return b[keep_]

    return rows.groupBy("node").applyInPandas(run, rows.schema)


def _rare_pairs(rows: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of nodes of any size: an equi-join on the rarest shingles of each set."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                some = b.iloc[i:i + 64]
                sets = [np.frombuffer(x, np.int64) for x in some["packed"]]
                yield some[["node", "id"]].loc[some.index.repeat([len(s) for s in sets])].assign(s=np.concatenate(sets))

    own = keep(rows.join(packed, "id").select("node", "id", "packed").mapInPandas(run, "node bigint, id binary, s bigint"), "near-left")
    often = own.groupBy("node", "s").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    member = Window.partitionBy("node", "id")
    # shingles of one member come first in the order but meet nobody: only their number counts
    ranked = own.join(often, ["node", "s"]).select("node", "id", "s", F.row_number().over(member.orderBy("often", "s")).alias("at"),
                                                   F.count(F.lit(1)).over(member).alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = ranked.join(rows, ["node", "id"]).withColumn("at", F.col("at") + F.col("n") - F.col("shared")).where(F.col("at") <= prefix).drop("shared")
    # most members of a node may have one label by now: they are met by the others, never by themselves
    major = (rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("major")))
    ranked = keep(ranked.join(major, "node").withColumn("most", F.col("label") == F.col("major")).drop("major"), "near-rare")
    x, y = ranked.where("not most").alias("x"), ranked.alias("y")
    # sets have in common at most what follows the first shingle they share: at later ones most pairs come no more
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    on = ((F.col("x.node") == F.col("y.node")) & (F.col("x.s") == F.col("y.s")) & (F.col("y.most") | (F.col("x.id") < F.col("y.id")))
          & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))) & _apart("x", "y") & _close(threshold, "x", "y"))
    return x.join(y, on).select(*_ordered(F.col("x.id"), F.col("y.id"))).distinct()


def exact_links(rows: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Nodes compared by the full sets of all members: every member with the
    root of its component inside the node."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("id")
        sets = [np.frombuffer(x, np.uint64) for x in b["packed"]]
        n = np.array([len(x) for x in sets])
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[which] > 1  # a shingle of one member adds to no intersection
        row, which = np.repeat(np.arange(len(sets)), n)[shared], which[shared]
        order = np.argsort(which, kind="stable")
        row, which = row[order], np.unique(which[order], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for begin in range(0, int(which.max(initial=-1)) + 1, 4096):
            a, z = np.searchsorted(which, [begin, begin + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[a:z], which[a:z] - begin] = 1
            both += x @ x.T
        near = np.empty(both.shape, bool)
        for i in range(0, len(sets), 256):
            inter = both[i:i + 256].astype(np.int64)
            near[i:i + 256] = 100 * inter >= percent * (n[i:i + 256, None] + n[None, :] - inter)
        np.fill_diagonal(near, True)
        root = np.arange(len(sets))
        while True:
            new = np.array([root[r].min() for r in near])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        ids = b["id"].to_numpy()
        at = np.flatnonzero(root != np.arange(len(sets)))
        return pd.DataFrame({"a": ids[at], "b": ids[root[at]]})

    return rows.select("node", "id").join(packed, "id").groupBy("node").applyInPandas(run, "a binary, b binary")


def _impure(rows: DataFrame) -> DataFrame:
    """Rows of nodes that still hold two labels not yet compared, with the node's size and shingles."""
    stats = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("bulk"), F.min("label").alias("l0"),
                                      F.max("label").alias("l1"), F.min("tag").alias("t0"), F.max("tag").alias("t1"), F.count("tag").alias("tags"))
             .where("size > 1 and l0 <> l1 and (tags < size or t0 <> t1)").select("node", "size", "bulk"))
    return rows.join(stats, "node")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small, middle and large nodes."""
    fits = (F.col("size") <= GROUP) & (F.col("bulk") <= SHINGLES)
    small = F.col("size") <= NODE
    return (*[rows.where(c).drop("size", "bulk", "held") for c in (small, ~small & fits)], rows.where(~small & ~fits))


def _moved(near: DataFrame, linked: DataFrame) -> DataFrame:
    """``node, label, to``: labels of a node that confirmed links join, with the label they take.
    Labels that met at one pivot's label are one; the second hop joins those that met at several."""
    hit = near.join(linked, ["a", "b"], "left_semi")
    least = hit.groupBy("node", "other").agg(F.least(F.min("label"), F.first("other")).alias("to"))
    met = hit.join(least, ["node", "other"])
    hop = met.select("node", "label", "to").union(met.select("node", "other", "to")).groupBy("node", "label").agg(F.min("to").alias("to"))
    hop = keep(hop, "near-labels")
    ahead = hop.select("node", F.col("label").alias("to"), F.col("to").alias("next"))
    return hop.join(ahead, ["node", "to"], "left").select("node", "label", F.least("to", F.coalesce("next", "to")).alias("to"))


def _large_nodes(rows: DataFrame, packed: DataFrame, width: int, threshold: float, percent: int, covered: int):
    """Work off large nodes: confirmed links, candidate pairs of what became small,
    ids met in nodes deeper than ``covered``, the greatest depth of a node, and the tags of members
    of nodes that were joined on rare shingles."""
    links, pairs, deep, depth, tags = [], [], [], 0, []
    rows = keep(rows, "near-large")
    while rows.take(1):
        if depth >= MAX_DEPTH:
            pairs.append(keep(_rare_pairs(rows, packed, threshold), "near-left"))
            tags.append(rows.select("id", F.col("node").cast("string").alias("tag")))
            break
        best = [F.min_by(F.struct("id", "n", "b0", "b1", "label", "tag"),
                         F.struct(F.col("label") != F.col("id"), F.xxhash64(F.lit(k), "id"), "id")) for k in range(PIVOTS)]
        pivot = rows.groupBy("node").agg(F.array_distinct(F.array(*best)).alias("p"))
        pivot = keep(pivot.select("node", F.inline("p")), "near-pivot")
        near = (rows.alias("x").join(pivot.alias("y"), (F.col("x.node") == F.col("y.node"))
                                     & _apart("x", "y") & _close(threshold, "x", "y"))
                .select("x.node", "x.label", F.col("y.label").alias("other"), _differ("x", "y").alias("differ"),
                        *_ordered(F.col("x.id"), F.col("y.id"))))
        near = keep(near, "near-pivots")
        # first every label with its closest pivot, then what still has two labels
        turn = near.groupBy("node", "label").agg(F.min(F.struct("differ", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        linked = keep(confirm(turn, packed, width, percent), "near-links")
        moved = _moved(near, linked)
        again = near.join(turn, ["a", "b"], "left_anti")
        for side, to in (("label", "to"), ("other", "to2")):
            again = again.join(moved.select("node", F.col("label").alias(side), F.col("to").alias(to)), ["node", side], "left")
        again = again.where(F.coalesce("to", "label") != F.coalesce("to2", "other")).select("a", "b").distinct()
        second = keep(confirm(again, packed, width, percent), "near-links")
        links += [linked, second]
        moved = _moved(near, linked.union(second))
        rest = rows.join(pivot.select("node", "id"), ["node", "id"], "left_anti")
        rest = keep(rest.join(moved, ["node", "label"], "left")
                    .select("node", "id", "n", "b0", "b1", F.coalesce("to", "label").alias("label"), "tag"), "near-rest")
        small, middle, large = _by_size(keep(_impure(rest), "near-impure"))
        down = keep(branch(large, packed, threshold), "near-down")
        small2, middle2, large = _by_size(keep(_impure(down), "near-impure"))
        names = ["node", "id", "n", "b0", "b1", "label", "tag"]
        small, middle, small2, middle2 = (t.select(*names) for t in (small, middle, small2, middle2))
        stalled, large = (large.where(c).select(*names) for c in (F.col("size") > STALL * F.col("held"), F.col("size") <= STALL * F.col("held")))
        if stalled.take(1):
            pairs.append(keep(_rare_pairs(stalled, packed, threshold), "near-stalled"))
            tags.append(stalled.select("id", F.col("node").cast("string").alias("tag")))
        pairs.append(keep(_small_pairs(small.union(small2), threshold, True).distinct(), "near-small"))
        links.append(keep(exact_links(close_members(middle.union(middle2), threshold), packed, percent), "near-links"))
        if depth + 2 > covered and down.take(1):  # the first nodes have depth 1
            deep.append((down.select("id").distinct(), depth + 2))
        rows = keep(large, "near-large")
        depth += 1
    return links, pairs, [ids for ids, _ in deep], max((d for _, d in deep), default=covered), tags


def _labelled(rows: DataFrame, label: DataFrame | None, tags: list[DataFrame]) -> DataFrame:
    """The rows with their component so far (their own id where nothing is linked) and one tag."""
    if label is None:
        rows = rows.withColumn("label", F.col("id"))
    else:
        rows = rows.join(label.withColumnRenamed("root", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    if not tags:
        return rows.withColumn("tag", F.lit(None).cast("string"))
    return rows.join(functools.reduce(DataFrame.union, tags).groupBy("id").agg(F.min("tag").alias("tag")), "id", "left")


def labels(links: DataFrame) -> DataFrame:
    """``id, root`` of linked ids after two hops to the least neighbour.  Ids with one root are
    connected; not all connected ids need have one, which only costs comparisons."""
    both = links.select("a", "b").union(links.select("b", "a"))
    one = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
    ahead = one.select(F.col("id").alias("root"), F.col("root").alias("next"))
    return one.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id of the links ``(a, b)``: alternating stars."""
    edges, before = keep(links.select("a", "b").distinct(), "stars"), None
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour to the least of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: the smaller neighbours and the id itself to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).distinct())
        # count and digest of the edges come with the write
        seen = Observation()
        h = F.xxhash64("a", "b")
        edges = keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")), "stars")
        now = tuple(seen.get.get(k) for k in ("n", "x", "s"))
        if now == before:
            break
        before = now
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members.union(edges.select(F.col("b"), F.col("b")).distinct())


def link_documents(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """``doc_id, text_hash, id, n_shingles, component_id, kept`` of every row;
    ``id`` is the digest of the set (null without words)."""
    percent = round(100 * threshold)
    base = keep(sketch(docs, width, threshold, trees_for(threshold, recall)), "near-base")
    sets = keep(base.where("n > 0").groupBy("id").agg(
        F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("b0").alias("b0"),
        F.any_value("b1").alias("b1"), F.any_value("nodes").alias("nodes")), "near-sets")
    tree = F.array(*[F.lit(t) for t, _ in roots(trees_for(threshold, recall), threshold)])
    rows = sets.select(F.posexplode("nodes").alias("at", "node"), "id", "n", "b0", "b1")
    rows = rows.select(F.get(tree, F.col("at")).alias("tree"), "node", "id", "n", "b0", "b1")
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("bulk")).where("size > 1")
    small, middle, large = _by_size(keep(rows.join(size, "node"), "near-nodes"))
    pairs = keep(_small_pairs(small, threshold, False).distinct(), "near-pairs")
    large = large.drop("size", "bulk")
    middle = keep(close_members(_labelled(middle, None, []), threshold).drop("label", "tag"), "near-middle")

    wanted = functools.reduce(DataFrame.union, [pairs.select(F.col("a").alias("id")), pairs.select("b"), middle.select("id"),
                                                large.select("id")]).distinct()
    wanted = keep(wanted.join(sets.select("id", "least", "n"), "id"), "near-wanted")
    size = 8 * (wanted.agg(F.sum("n")).first()[0] or 0)
    packed = keep_dealt(_packed(docs, wanted, width), "near-packed", "id", _buckets(docs.sparkSession, size))

    links, deep, tags, covered, reached = [], [], [], RECALL_DEPTH, RECALL_DEPTH
    label = None
    for begin, end in zip((0, *ROUNDS), (*ROUNDS, None)):
        now = F.col("tree") >= begin if end is None else F.col("tree").between(begin, end - 1)
        some = _labelled(middle.where(now).drop("tree"), label, tags)
        links.append(keep(exact_links(close_members(_impure(some).drop("size", "bulk"), threshold), packed, percent), "near-links"))
        heavy = _impure(_labelled(large.where(now).drop("tree"), label, tags)).drop("size", "bulk")
        found, more, ids, depth, told = _large_nodes(heavy, packed, width, threshold, percent, covered)
        links, deep, tags, reached = links + found, deep + ids, tags + told, max(reached, depth)
        for p in more:
            pairs = pairs.union(p)
        if end is not None:
            label = keep(labels(functools.reduce(DataFrame.union, links)), "near-roots")
    trees = trees_for(threshold, recall)
    # nodes deeper than the trees were sized for: their members get the trees that the depth asks for
    while deep and trees_for(threshold, recall, reached) > trees:
        begin, trees, covered = trees, trees_for(threshold, recall, reached), reached
        label = keep(labels(functools.reduce(DataFrame.union, links)), "near-roots")
        members = functools.reduce(DataFrame.union, deep).distinct().join(sets.select("id", "n", "b0", "b1"), "id")
        rows = keep(more_trees(_labelled(members, label, tags), packed, threshold, begin, trees), "near-nodes")
        small, middle, large = _by_size(keep(_impure(rows), "near-impure"))
        pairs = pairs.union(keep(_small_pairs(small, threshold, True).distinct(), "near-small"))
        links.append(keep(exact_links(close_members(middle, threshold), packed, percent), "near-links"))
        found, more, deep, reached, told = _large_nodes(large.drop("size", "bulk"), packed, width, threshold, percent, covered)
        links, tags = links + found, tags + told
        for p in more:
            pairs = pairs.union(p)
    pairs = keep(pairs.distinct(), "near-pairs")
    # first turn: everyone with the least candidate partner
    ends = pairs.union(pairs.select("b", "a"))
    turn = ends.groupBy("a").agg(F.min("b").alias("b")).select(*_ordered(F.col("a"), F.col("b"))).distinct()
    links.append(keep(confirm(turn, packed, width, percent), "near-links"))
    joined = keep(components(functools.reduce(DataFrame.union, links)), "near-roots")
    ra = joined.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    rb = joined.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    open_pairs = (pairs.join(turn, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
                  .where("ra is null or rb is null or ra <> rb").select("a", "b"))
    last = keep(confirm(open_pairs, packed, width, percent), "near-links")
    if last.take(1):
        joined = keep(components(joined.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(last)),
                      "near-roots")
    named = joined.join(sets.select("id", "least"), "id")
    roots_ = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("id", "root").join(roots_, "root").select("id", "component_id")
    own = sets.select("id", "least").join(named, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))
    out = base.select("doc_id", "text_hash", "id", "n").join(own, "id", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def _buckets(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes, two for a core at least.  The number divides the shuffle's partitions, so each
    of them writes to one bucket."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(-(-size // BUCKET), 2 * spark.sparkContext.defaultParallelism)
    return next((n for n in range(least, most) if most % n == 0), most)


def _packed(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id, packed`` of the wanted sets, from the document with the least id."""
    w = wanted.select("least", F.col("id").alias("want"))
    # merged at any size: the documents move once, so the run on a small table tells of a large one
    rows = docs.select("doc_id", "text").join(w.hint("merge"), F.col("doc_id").eqNullSafe(F.col("least"))).select("want", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for want, text in zip(b["want"], b["text"]):
                s = shingles(text, width)
                # an id may come with several texts: take the one that is meant
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(want):
                    out.append((want, s.tobytes()))
            yield pd.DataFrame(out, columns=["id", "packed"])

    return rows.mapInPandas(run, "id binary, packed binary").dropDuplicates(["id"])


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each group of near copies, with the columns it came with: the
    one with the least id.  Equal rows are one document; texts that share an
    id are told apart by their digest."""
    named = docs.select("doc_id", "text")
    marked = link_documents(named, width, threshold).where("kept")
    marked = keep(marked.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "near-kept")
    marked = marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_th"))
    once = whole.join(marked.where("copies = 1"), same, "left_semi")
    often = whole.join(marked.where("copies > 1"), same, "left_semi").withColumns(
        {"_id": F.col("_doc.doc_id"), "_th": F.xxhash64("_doc.text")}).dropDuplicates(["_id", "_th"]).select("_doc")
    return once.union(often).select("_doc.*")
