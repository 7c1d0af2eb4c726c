"""Embedding whitening by Chebyshev-filtered subspace iteration.

Each finite entry ``c`` becomes the whole number ``floor(SCALE * c) + OFFSET``.
Rows are packed once into blocks of the narrowest integer type that holds them, in the
shared folder; all later passes read those blocks.  One pass sums each
dimension exactly.  A pass of the iteration is ``X'XQ`` over centred rows: tasks
multiply block by block and sum inside the task, Spark sums the tasks'
matrices entry by entry, so the driver sees only matrices of the
vectors' length times the block's width, whatever the number of rows.

The spectrum above the block's least Ritz value is wanted, the one below is damped:
a scaled Chebyshev recurrence whose degree is chosen from the predicted growth,
then QR and Rayleigh-Ritz.  The product of the Rayleigh-Ritz step starts the next
recurrence, so a cycle of degree ``k`` costs ``k`` passes.  The iteration ends when every wanted pair is
certified: its residual is at most ``TOLERANCE`` times the greatest
eigenvalue.  Where the spectrum is so flat that this would take more than
``PATIENCE`` further passes, the block is doubled (at the vectors' length
Rayleigh-Ritz is exact), so it always ends.

Centring is exact: whole sums give the mean as a whole part and a remainder.

Defined cases: rows whose vector is null, holds null or non-finite entries, or is not
of the table's most frequent length are dropped; whole numbers are held
within +-2**61; components whose eigenvalue is below ``RANK`` times
the greatest are not there (a constant column, fewer rows than
components), so a table of equal vectors gives rows without components; repeated rows and
null ids each give their own row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import keep
from corpusflow.llm.vectors import common_length, matrix

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
GUARD = 24
MAX_DEGREE = 16
PATIENCE = 64
TOLERANCE = 1e-13
RANK = 1e-12
BLOCK_VALUES = 1 << 20
LIMIT = 1 << 61


@dataclass
class Whitening:
    """The fitted transform: eigenpairs of the covariance, and its certificate."""

    n: int
    sums: list[int]  # of floor(SCALE * c), each dimension
    values: np.ndarray
    vectors: np.ndarray  # one column for each component
    trace: float
    residual: float  # greatest of the certified pairs, over the greatest eigenvalue
    passes: int
    identity_error: float = 0.0

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean as whole part and remainder below one."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def pack(df: DataFrame, d: int) -> DataFrame:
    """``ids, n, kind, block``: whole numbers ``floor(SCALE * c)`` of the kept rows."""
    per_block = max(1, BLOCK_VALUES // d)
    id_type = df.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, x = matrix(b.column("embedding"), d)
            ids = b.column("vec_id").filter(pa.array(mask))
            f = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype(np.int64)
            for i in range(0, len(f), per_block):
                part, names = f[i:i + per_block], ids[i:i + per_block]
                top = int(np.abs(part).max(initial=0))
                kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([len(names)], pa.int32()),
                     pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["ids", "n", "kind", "block"])

    return df.select("vec_id", "embedding").mapInArrow(run, f"ids array<{id_type}>, n int, kind string, block binary")


def unpack(kind: str, block: bytes, d: int) -> np.ndarray:
    return np.frombuffer(block, kind).reshape(-1, d)


def centred(f: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if f.dtype.itemsize < 8:
        return (f.astype(np.float64) - whole) - rest
    return (f - whole).astype(np.float64) - rest


def exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * (d + 1)
        for b in batches:
            for kind, block in zip(b["kind"], b["block"]):
                f = unpack(kind, block, d)
                wide = f.astype(object) if f.dtype.itemsize == 8 else f.astype(np.int64)
                for j, s in enumerate(wide.sum(0)):
                    total[j] += int(s)
                total[d] += len(f)
        yield pd.DataFrame({"at": range(d + 1), "value": [str(t) for t in total]})

    rows = (blocks.select("kind", "block").mapInPandas(run, "at int, value string")
            .groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())  # d + 1 rows
    found = {r["at"]: int(r["value"]) for r in rows}
    return found.get(d, 0), [found.get(j, 0) for j in range(d)]


def _summed(blocks: DataFrame, shape: tuple[int, int], each) -> np.ndarray:
    """Sum over all blocks of the matrix ``each(kind, block)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            for kind, block in zip(b["kind"], b["block"]):
                total += each(kind, block)
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    rows = (blocks.select("kind", "block").mapInPandas(run, "at int, value double")
            .groupBy("at").agg(F.sum("value").alias("value")).toPandas())  # shape entries, whatever the rows
    out = np.zeros(shape[0] * shape[1])
    out[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return out.reshape(shape)


def fit(blocks: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Greatest eigenpairs of the covariance of all packed rows."""
    n, sums = exact_sums(blocks, d)
    if not n:
        return None
    model = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0, 0.0, 0)
    whole, rest = model.centre

    def times(q: np.ndarray) -> np.ndarray:
        def each(kind, block):
            y = centred(unpack(kind, block, d), whole, rest)
            return y.T @ (y @ q)

        model.passes += 1
        return _summed(blocks, q.shape, each) / n

    model.trace = float(_summed(blocks, (1, 1), lambda kind, block: np.square(centred(unpack(kind, block, d), whole, rest)).sum())[0, 0]) / n
    if model.trace <= 0:
        return model
    wanted = min(components, d)
    rng = np.random.default_rng(20240917)
    q = np.linalg.qr(rng.standard_normal((d, min(d, wanted + GUARD))))[0]
    aq = times(q)
    before, stuck = np.inf, 0
    while True:
        # Rayleigh-Ritz
        h = q.T @ aq
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        size = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0).max() / theta[0]
        stuck = stuck + 1 if size > before / 2 else 0
        before = size
        # rounding may end just above the tolerance: then further passes change nothing
        if size <= TOLERANCE or (stuck >= 3 and size <= 100 * TOLERANCE):
            break
        edge = max(theta[-1], 1e-9 * theta[0])
        growth = _growth(max(theta[wanted - 1], edge), edge)
        needed = np.log(size / TOLERANCE) / max(np.log(growth), 1e-9)
        if q.shape[1] < d and needed > PATIENCE:
            fresh = rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))
            q = np.linalg.qr(np.hstack([q, fresh]))[0]
            aq, before, stuck = times(q), np.inf, 0
            continue
        if q.shape[1] == d:  # the block is the whole space: the pairs are exact up to rounding
            q = np.linalg.qr(q)[0]
            if stuck >= 2:
                break
            aq = times(q)
            continue
        q = chebyshev(times, q, aq, int(np.clip(np.ceil(needed), 2, MAX_DEGREE)), edge, theta[0])
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
        aq = times(q)
    there = theta[:wanted] > RANK * theta[0]
    model.values, model.vectors, model.residual = theta[:wanted][there], q[:, :wanted][:, there], float(size)
    # one sign for all rows: the entry of greatest size is positive
    top = np.abs(model.vectors).argmax(0)
    model.vectors = model.vectors * np.sign(model.vectors[top, np.arange(len(top))])
    model.identity_error = identity_error(blocks, d, model)
    return model


def _growth(value: float, edge: float) -> float:
    """Factor by which one degree lifts ``value`` above the damped interval ``[0, edge]``."""
    x = max(2 * value / edge - 1, 1.0)
    return x + np.sqrt(x * x - 1)


def chebyshev(times, q: np.ndarray, aq: np.ndarray, degree: int, edge: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small on ``[0, edge]`` and one at ``top``, times ``q``."""
    half = edge / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    old, new = q, (aq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        old, new = new, (times(new) - half * new) * (2 * after / half) - old * (sigma * after)
        sigma = after
    return new


def identity_error(blocks: DataFrame, d: int, model: Whitening) -> float:
    """Greatest entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = len(model.values)
    if not k:
        return 0.0
    whole, rest = model.centre
    w = model.vectors / np.sqrt(model.values)

    def each(kind, block):
        z = centred(unpack(kind, block, d), whole, rest) @ w
        return np.vstack([z.T @ z, z.sum(0)])

    total = _summed(blocks, (k + 1, k), each) / model.n
    cov = total[:k] - np.outer(total[k], total[k])  # rows are centred already: the second term is rounding
    return float(np.abs(cov - np.eye(k)).max())


def apply(blocks: DataFrame, d: int, model: Whitening) -> DataFrame:
    """``vec_id, deviation decimal(38,0), whitened array<double>`` of every packed row."""
    whole, rest = model.centre
    n = model.n
    over = np.array([s - w * n for s, w in zip(model.sums, whole.tolist())], np.int64)
    w = model.vectors / np.sqrt(model.values)
    k = len(model.values)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def deviations(f: np.ndarray) -> tuple[np.ndarray, list]:
        """Sums of squares of ``n * x - S``: as longs, or as text where a long is too short."""
        gap = f.astype(np.int64) - whole
        top = (int(np.abs(gap).max(initial=0)) + 1) * n
        if top * top * d < 1 << 63:
            return np.square(n * gap - over).sum(1), [None] * len(f)
        wide = n * gap.astype(object) - over.astype(object)
        return np.zeros(len(f), np.int64), [str(v) for v in (wide * wide).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                f = unpack(b.column("kind")[i].as_py(), b.column("block")[i].as_py(), d)
                z = centred(f, whole, rest) @ w
                short, long = deviations(f)
                offsets = pa.array(np.arange(len(f) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.array(short), pa.array(long, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["vec_id", "short", "long", "whitened"])

    rows = blocks.select("ids", "kind", "block").mapInArrow(run, f"vec_id {id_type}, short bigint, long string, whitened array<double>")
    exact = F.coalesce(F.col("long").cast("decimal(38,0)"), F.col("short").cast("decimal(38,0)"))
    return rows.select("vec_id", exact.alias("deviation"), "whitened")


def whiten(df: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """All rows of ``df`` (``vec_id, embedding``) whitened, and the fitted transform."""
    d = common_length(df, "embedding")
    if d:
        blocks = keep(pack(df, d), "whitening-blocks")
        model = fit(blocks, d, components)
        if model:
            return apply(blocks, d, model), model
    id_type = df.schema["vec_id"].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"), None
