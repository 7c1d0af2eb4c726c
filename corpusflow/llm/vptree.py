"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Inner products become distances by one more coordinate: with ``M`` the greatest
norm, a vector ``x`` is the point ``(x, sqrt(M^2 - |x|^2))`` and a query the point ``(q, 0)``, so
nearer means a larger product and the triangle inequality holds.

Equal vectors are one point that carries the ids a query can need (its ``k + 1``
smallest).  A top tree, fitted on the ``SAMPLE`` points with the smallest digests,
deals all points to cells; a cell is split into shards of at most
``SHARD_VALUES`` numbers.  Every point is in exactly one shard.  A task that meets a shard
builds its tree: a node holds a vantage point and, for the nearer and the farther half of its
points, the least and the greatest distance to it.

A subtree is skipped when the triangle inequality puts all of it beyond the ``k``-th
neighbour found so far: ``factor * (gap to its interval of distances) > distance
of the k-th``.  Factor one skips nothing that could hold a neighbour: the search is
exact.  Greater factors skip more and may lose neighbours.

Queries first search the shard they lie in, which bounds their ``k``-th distance, then
the shards of all cells whose intervals (over all points of the cell, measured, not sampled) the
bound does not rule out, and send on only what is as good as the bound.  A
task holds one shard and at most ``QUERY_VALUES`` numbers of queries.  Rounding cannot
skip a neighbour: the comparison leaves ``SLACK`` of the greatest distance.

Scores are inner products of the original vectors in double precision, ties go to
the smaller id.

Defined cases: vectors that are null, zero, hold null or non-finite entries or are not of
the table's most frequent length take no part, nor do rows without an id;
equal rows (id and vector) are one row, rows of one id with different vectors are
different rows; a query has as many neighbours as there are other rows, none
in a table of one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.common import keep
from corpusflow.llm.vectors import common_length, matrix

FACTOR = 1.0
LEAF = 256
SAMPLE = 16_384
SAMPLE_VALUES = 1 << 22
MAX_CELLS = 1_024
CELL_SAMPLE = 16
SHARD_VALUES = 1 << 22
SMALL_SHARD = 2_048
QUERY_VALUES = 1 << 24
ROUTED_ROWS = 1 << 16
SLACK = 1e-7


# ---- trees ----

def _spread_vantage(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few points, the one whose distances to a sample differ most."""
    some = points[rng.integers(0, len(points), min(8, len(points)))]
    probe = points[rng.integers(0, len(points), min(128, len(points)))]
    return some[np.var(distances(some, probe), axis=1).argmax()]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points; rows of ``a`` by rows of ``b``."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Vantage-point tree over ``points``; leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (begin, end) or (vantage, (lo, hi, child) near, (lo, hi, child) far)
        rng = np.random.default_rng(seed)

        def grow(begin: int, end: int) -> int:
            at = len(self.nodes)
            self.nodes.append((begin, end))
            if end - begin <= leaf:
                return at
            own = self.order[begin:end]
            vantage = _spread_vantage(points[own], rng)
            d = distances(points[own], vantage[None])[:, 0]
            half = (end - begin) // 2
            split = np.argpartition(d, half)
            self.order[begin:end], d = own[split], d[split]
            near = (d[:half].min(), d[:half].max(), grow(begin, begin + half))
            far = (d[half:].min(), d[half:].max(), grow(begin + half, end))
            self.nodes[at] = (vantage, near, far)
            return at

        grow(0, len(points))


def gap(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """How far a query at distance ``d`` from a vantage point is from all points within ``[low, high]`` of it."""
    return np.maximum(np.maximum(d - high, low - d), 0)


class Best:
    """The ``k`` best points of each query: largest score, then smallest id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), -np.inf)
        self.point = np.full((n, k), -1)
        self.last = np.full(n, -np.inf) if floor is None else floor.copy()
        self.k = k

    def offer(self, who: np.ndarray, score: np.ndarray, point: np.ndarray, least_id: np.ndarray) -> None:
        """``score[i, j]`` of query ``who[i]`` and ``point[j]``."""
        better = (score >= self.last[who, None]).any(1)
        who, score = who[better], score[better]
        if not len(who):
            return
        s = np.hstack([self.score[who], score])
        p = np.hstack([self.point[who], np.broadcast_to(point, score.shape)])
        cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        chosen = s >= cut[:, None]
        plain = chosen.sum(1) == self.k
        if plain.any():
            rows = who[plain]
            self.score[rows] = s[plain][chosen[plain]].reshape(-1, self.k)
            self.point[rows] = p[plain][chosen[plain]].reshape(-1, self.k)
        for i in np.flatnonzero(~plain):  # ties at the last place
            ids = np.where(p[i] >= 0, least_id[p[i]], np.iinfo(np.int64).max)
            first = np.lexsort((ids, -s[i]))[:self.k]
            self.score[who[i]], self.point[who[i]] = s[i][first], p[i][first]
        self.last[who] = np.maximum(self.last[who], cut)


def search(tree: Tree, vectors: np.ndarray, least_id: np.ndarray, queries: np.ndarray, k: int, radius: float,
           factor: float, floor: np.ndarray | None = None) -> tuple[Best, int]:
    """The ``k`` best points of every query, and how many products were formed.

    ``floor`` is a score below which nothing is wanted (none: queries first look
    into the leaf they fall into)."""
    best = Best(len(queries), k, floor)
    square = (queries * queries).sum(1)
    slack = SLACK * (radius + np.sqrt(square))
    formed = 0

    def reach(who):
        return np.sqrt(np.maximum(square[who] + radius * radius - 2 * best.last[who], 0)) + slack[who]

    def away(who, vantage):
        """Distances of queries to a vantage point."""
        d = square[who] + vantage @ vantage - 2 * (queries[who] @ vantage[:-1])
        return np.sqrt(np.maximum(d, 0))

    def look(node, who):
        nonlocal formed
        own = tree.order[node[0]:node[1]]
        formed += len(who) * len(own)
        best.offer(who, queries[who] @ vectors[own].T, own, least_id)

    everyone = np.arange(len(queries))
    home = np.full(len(queries), -1)
    if floor is None:
        stack = [(0, everyone)]
        while stack:
            at, who = stack.pop()
            node = tree.nodes[at]
            if not len(who):
                continue
            if len(node) == 2:
                home[who] = at
                look(node, who)
                continue
            vantage, near, far = node
            d = away(who, vantage)
            nearer = gap(d, *near[:2]) <= gap(d, *far[:2])
            stack += [(near[2], who[nearer]), (far[2], who[~nearer])]
    stack = [(0, everyone, np.zeros(len(queries)))]
    while stack:
        at, who, least = stack.pop()
        open_ = factor * least <= reach(who)
        who, least = who[open_], least[open_]
        if not len(who):
            continue
        node = tree.nodes[at]
        if len(node) == 2:
            look(node, who[home[who] != at])
            continue
        vantage, near, far = node
        d = away(who, vantage)
        for low, high, child in (far, near):
            stack.append((child, who, np.maximum(least, gap(d, low, high))))
    return best, formed


# ---- points ----

def _points(df: DataFrame, d: int) -> DataFrame:
    """``key, vec_id, square, vec``: rows that take part; ``key`` is the vector's digest."""
    id_type = df.schema["vec_id"].dataType.simpleString()
    wide = df.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = "<f8" if wide else "<f4"  # the vectors' own precision: nothing is rounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, x = matrix(b.column("embedding"), d)
            there = x.any(1)
            mask[mask] = there
            x = (x[there] + 0.0).astype(kind)  # one zero, not two
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), b.column("vec_id").filter(pa.array(mask)),
                 pa.array(np.square(x.astype(np.float64)).sum(1)), pa.array(raw, pa.binary())], ["key", "vec_id", "square", "vec"])

    rows = df.where("vec_id is not null").select("vec_id", "embedding")
    return rows.mapInArrow(run, f"key binary, vec_id {id_type}, square double, vec binary")


def floats(column: pa.ChunkedArray | pa.Array, width: int, d: int) -> np.ndarray:
    """A binary column of vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), f"<f{width}").reshape(-1, d).astype(np.float64)


def _lifted(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    lift = np.sqrt(np.maximum(radius * radius - (x * x).sum(1), 0))
    return lift, np.hstack([x, lift[:, None]])


class Cells:
    """Top tree: deals points to cells and names the cells a query has to visit."""

    def __init__(self, points: np.ndarray, cells: int):
        leaf = max(CELL_SAMPLE, -(-len(points) // cells))
        self.tree = Tree(points, leaf)
        self.leaves = [i for i, n in enumerate(self.tree.nodes) if len(n) == 2]
        self.number = {node: i for i, node in enumerate(self.leaves)}
        self.inner = [i for i, n in enumerate(self.tree.nodes) if len(n) == 3]
        self.vantage = np.array([self.tree.nodes[i][0] for i in self.inner]).reshape(-1, points.shape[1])
        self.path = {}  # cell: the inner nodes above it
        stack = [(0, [])]
        while stack:
            at, above = stack.pop()
            if at in self.number:
                self.path[self.number[at]] = above
            else:
                above = [*above, self.inner.index(at)]
                stack += [(child[2], above) for child in self.tree.nodes[at][1:]]
        self.depth = max(map(len, self.path.values()))

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every point, and its distances to the vantage points above the cell (padded with nan)."""
        cell = np.zeros(len(points), np.int64)
        away = np.full((len(points), self.depth), np.nan)
        stack = [(0, np.arange(len(points)), 0)]
        while stack:
            at, who, level = stack.pop()
            if at in self.number:
                cell[who] = self.number[at]
                continue
            vantage, near, far = self.tree.nodes[at]
            d = distances(points[who], vantage[None])[:, 0]
            away[who, level] = d
            nearer = d <= (near[1] + far[0]) / 2
            stack += [(near[2], who[nearer], level + 1), (far[2], who[~nearer], level + 1)]
        return cell, away


def _deal(points: DataFrame, d: int, width: int, radius: float, cells: Cells) -> DataFrame:
    """``cell, away`` of every point: where the top tree puts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = cells.assign(_lifted(floats(b.column("vec"), width, d), radius)[1])
            offsets = pa.array(np.arange(len(cell) + 1) * cells.depth, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.ListArray.from_arrays(offsets, pa.array(away.ravel(), from_pandas=True))], ["cell", "away"])

    return points.select("vec").mapInArrow(run, "cell bigint, away array<double>")


def _shards(points: DataFrame, d: int, width: int, radius: float, cells: Cells, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """All points with their shard: one of the shards of the point's cell, by digest."""
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, _ = cells.assign(_lifted(floats(b.column("vec"), width, d), radius)[1])
            draw = np.array([int.from_bytes(k[:7], "little") for k in b.column("key").to_pylist()], np.int64)
            shard = first[cell] + draw % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[b.column(c) for c in names]], ["shard", *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"shard bigint, {fields}")


class _Shard:
    """One shard in a task: its vectors, the order of its ids, its tree."""

    def __init__(self, table: pa.Table, d: int, width: int, radius: float):
        self.ids = table["ids"].combine_chunks()
        self.vectors = floats(table["vec"], width, d)
        offsets = self.ids.offsets.to_numpy()[:-1]
        self.least = np.empty(len(self.vectors), np.int64)
        self.least[pc.sort_indices(self.ids.values.take(pa.array(offsets))).to_numpy()] = np.arange(len(self.vectors))
        self.lift, lifted = _lifted(self.vectors, radius)
        self.tree = Tree(lifted)

    def find(self, queries: np.ndarray, most: int, radius: float, factor: float, floor: np.ndarray | None) -> Best:
        return search(self.tree, self.vectors, self.least, queries, most, radius, factor, floor)[0]


def _answer(shard: _Shard, best: Best, keys: pa.Array, own: np.ndarray, floor: np.ndarray) -> pa.Table:
    """``key, score, ids, own`` of all found points that reach the floor."""
    who, at = np.nonzero((best.point >= 0) & (best.score >= floor[:, None]))
    point = best.point[who, at]
    return pa.table({"key": keys.take(pa.array(who)), "score": pa.array(best.score[who, at]),
                     "ids": shard.ids.take(pa.array(point)), "own": pa.array(point == own[who])})


def nearest(df: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``df`` of every row of
    ``queries`` (rows of ``df`` themselves; both ``vec_id, embedding``), its own row apart."""
    spark = df.sparkSession
    id_type = df.schema["vec_id"].dataType.simpleString()
    width = 4 if df.schema["embedding"].dataType.elementType.simpleString() == "float" else 8
    d = common_length(df, "embedding")
    none = spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    if not d:
        return none
    most = k + 1  # a query may find itself

    # equal vectors: one point with its smallest ids; the window keeps at most ``most`` rows of a key in each map task
    first_ids = Window.partitionBy("key").orderBy("vec_id")
    rows = _points(df, d).withColumn("_at", F.dense_rank().over(first_ids)).where(F.col("_at") <= most)
    points = rows.groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("square").alias("square"),
                                     F.first("vec").alias("vec"))
    asked = keep(_points(queries, d).select("key", F.col("vec_id").alias("query_id")).distinct(), "vptree-asked")
    points = points.join(asked.select("key").distinct().withColumn("asked", F.lit(True)), "key", "left")
    points = keep(points.select("key", "ids", "square", "vec", F.coalesce("asked", F.lit(False)).alias("asked")), "vptree-points")
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("m"), F.count_if("asked").alias("q")).first()
    if not size["q"]:
        return none
    n, radius, n_queries = size["n"], float(np.sqrt(size["m"])), size["q"]

    # cells from a bounded sample, their sizes and intervals from all points
    per_shard = max(1, SHARD_VALUES // d)
    wanted = max(-(-n // per_shard), min(-(-n // SMALL_SHARD), spark.sparkContext.defaultParallelism))
    sample = floats(points.orderBy("key").select("vec").limit(min(SAMPLE, SAMPLE_VALUES // d + 1)).toArrow()["vec"], width, d)
    cells = Cells(_lifted(sample, radius)[1], min(wanted, MAX_CELLS))
    levels = range(cells.depth)
    found = (_deal(points, d, width, radius, cells).groupBy("cell")
             .agg(F.count(F.lit(1)).alias("n"), *[F.min(F.get("away", F.lit(i))).alias(f"lo{i}") for i in levels],
                  *[F.max(F.get("away", F.lit(i))).alias(f"hi{i}") for i in levels]).collect())  # a row for each cell
    count = np.zeros(len(cells.leaves), np.int64)
    low, high = np.full((len(count), len(cells.inner)), -np.inf), np.full((len(count), len(cells.inner)), np.inf)
    for r in found:
        count[r["cell"]] = r["n"]
        above = cells.path[r["cell"]]
        low[r["cell"], above] = [r[f"lo{i}"] for i in range(len(above))]
        high[r["cell"], above] = [r[f"hi{i}"] for i in range(len(above))]
    parts = np.maximum(-(-count // per_shard), 1)
    first = np.cumsum(parts) - parts
    cells.tree.order = None

    shards = _shards(points, d, width, radius, cells, first, parts)
    fields = f"key binary, score double, ids array<{id_type}>, own boolean"

    def at_home(t: pa.Table) -> pa.Table:
        shard = _Shard(t, d, width, radius)
        who = np.flatnonzero(t["asked"].combine_chunks().to_numpy(zero_copy_only=False))
        best = shard.find(shard.vectors[who], most, radius, factor, None)
        got = _answer(shard, best, t["key"].combine_chunks().take(pa.array(who)), who, np.full(len(who), -np.inf))
        # one row for each query: what it found, and the score it has to beat elsewhere
        size = (best.point >= 0).sum(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        entries = pa.StructArray.from_arrays([got[c].combine_chunks() for c in ("score", "ids", "own")], ["score", "ids", "own"])
        return pa.table({"key": t["key"].take(pa.array(who)), "vec": t["vec"].take(pa.array(who)), "shard": t["shard"].take(pa.array(who)),
                         "floor": pa.array(best.last), "found": pa.ListArray.from_arrays(offsets, entries)})

    home = keep(shards.groupBy("shard").applyInArrow(
        at_home, f"key binary, vec binary, shard bigint, floor double, found array<struct<score:double,ids:array<{id_type}>,own:boolean>>"),
        "vptree-home")

    query_parts = max(1, -(-n_queries * d // QUERY_VALUES))
    shard_cell = np.repeat(np.arange(len(parts)), parts)
    step = max(1, ROUTED_ROWS // len(shard_cell))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query with the shards that its bound does not rule out."""
        for whole in batches:
            for begin in range(0, len(whole), step):
                b = whole.slice(begin, step)
                q = floats(b.column("vec"), width, d)
                floor = b.column("floor").to_numpy()
                square = (q * q).sum(1)
                reach = np.sqrt(np.maximum(square + radius * radius - 2 * floor, 0)) + SLACK * (radius + np.sqrt(square))
                least = np.zeros((len(q), len(parts)))
                for i, v in enumerate(cells.vantage):
                    away = np.sqrt(np.maximum(square + v @ v - 2 * (q @ v[:-1]), 0))
                    least = np.maximum(least, gap(away[:, None], low[None, :, i], high[None, :, i]))
                open_ = (factor * least <= reach[:, None]) & (count > 0)
                who, shard = np.nonzero(open_[:, shard_cell])
                away_from_home = shard != b.column("shard").to_numpy()[who]
                who, shard = who[away_from_home], shard[away_from_home]
                draw = np.array([int.from_bytes(x[7:11], "little") for x in b.column("key").to_pylist()], np.int64)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array(draw[who] % query_parts), *[b.column(c).take(take) for c in ("key", "vec", "floor")]],
                    ["shard", "part", "key", "vec", "floor"])

    def elsewhere(points: pa.Table, queries: pa.Table) -> pa.Table:
        floor = queries["floor"].to_numpy()
        if not len(points) or not len(queries):
            return pa.table({"key": pa.array([], pa.binary()), "score": pa.array([], pa.float64()),
                             "ids": points["ids"].combine_chunks()[:0], "own": pa.array([], pa.bool_())})
        shard = _Shard(points, d, width, radius)
        best = shard.find(floats(queries["vec"], width, d), most, radius, factor, floor)
        return _answer(shard, best, queries["key"].combine_chunks(), np.full(len(floor), -2), floor)

    routed = home.select("key", "vec", "shard", "floor").mapInArrow(
        route, "shard bigint, part bigint, key binary, vec binary, floor double")
    held = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_parts - 1).cast("bigint"))).alias("part"), "ids", "vec")
    far = held.groupBy("shard", "part").cogroup(routed.groupBy("shard", "part")).applyInArrow(elsewhere, fields)

    near = home.select("key", F.inline("found")).select("key", "score", "ids", "own")
    entries = near.unionByName(far).select("key", "score", "own", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = (entries.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
           .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_at", "vec_id", "score", "own"))).alias("top")))
    kept = F.filter("top", lambda e: ~(e["own"] & (e["vec_id"] == F.col("query_id"))))
    return (asked.join(top, "key").select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("_at", "_e"))
            .select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score")))
