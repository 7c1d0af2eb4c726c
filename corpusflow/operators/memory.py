"""Document memory tables (MEM1-MEM11).

The in-process ``{doc_id -> (K, V)}`` store becomes two long tables:
``doc_memory`` (one row per document: summary key/value vectors, metadata,
content hash, version) and ``token_memory`` (one row per real token).
Padding never exists as rows.  Updates are keyed overwrites written as new
snapshots.  The encoder is pluggable (``mapInArrow``); the default is a
hashed token vector (one md5 per token, 16 dims from its 16 bytes).
"""

from __future__ import annotations

import fnmatch
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIM = 16


def hashed_dims(token: Column) -> list[Column]:
    """The numbers of :func:`hashed_vector`, one column each."""
    h = F.md5(token)
    words = [F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("bigint") for j in range(HASH_DIM // 4)]
    return [((F.shiftright(words[d // 4], 8 * (3 - d % 4)).bitwiseAND(255)).cast("double") - 127.5) / 127.5 for d in range(HASH_DIM)]


def hashed_vector(token: Column) -> Column:
    """Default token encoder: byte i of md5(token) -> (b - 127.5) / 127.5.

    Plain expressions (no lambda) so it stays inside whole-stage codegen:
    four 32-bit words are parsed from the hex digest and the bytes taken
    with shifts and masks."""
    return F.array(*hashed_dims(token))


# --- MEM6/MEM7/MEM10: tokens and chunks -----------------------------------------

def chunk_tokens(docs: DataFrame, chunk_len: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """MEM10: documents -> ``(doc_id, chunk_idx, tokens)`` with ``chunk_len``
    whitespace tokens per chunk; a document without tokens yields none."""
    words = F.filter(F.split(F.col(text), " "), lambda w: w != "")
    w = docs.select(key, words.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(chunk_len))
    c = w.select(key, F.transform(starts, lambda s: F.slice(F.col("_w"), s + 1, chunk_len)).alias("_c"))
    # keep the chunk array as its own column (referenced twice), so the
    # generator explodes a computed value instead of re-running the lambda
    c = c.select(key, "_c", F.size("_c").alias("_n"))
    return c.select(key, F.posexplode("_c").alias("chunk_idx", "tokens"))


def doc_token_rows(docs: DataFrame, chunk_len: int = 512, key: str = "doc_id", text: str = "text", more: tuple = ()) -> DataFrame:
    """MEM7 straight from text: one row per real token with its chunk and
    position in the chunk (the same layout as ``token_rows(chunk_tokens)``),
    exploding words once instead of building chunk arrays first.  ``more``
    columns of a document go with each of its tokens."""
    words = F.filter(F.split(F.col(text), " "), lambda w: w != "")
    t = docs.select(key, *more, F.posexplode(words).alias("_p", "token"))
    return t.select(key, *more, (F.col("_p") / chunk_len).cast("int").alias("chunk_idx"),
                    (F.col("_p") % chunk_len).cast("int").alias("pos"), "token")


def token_rows(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """MEM7: one row per real token with its position (no padding rows)."""
    return chunks.select(*keys, F.posexplode("tokens").alias("pos", "token"))


def token_table(chunks: DataFrame, keys: list[str], encoder: Column | None = None) -> DataFrame:
    """MEM6 + MEM7: one row per real token with its position and vector.

    ``encoder`` maps the ``token`` column to a vector (default hashed)."""
    t = token_rows(chunks, keys)
    enc = encoder if encoder is not None else hashed_vector(F.col("token"))
    return t.withColumn("vec", enc)


def pandas_encoder(fn: Callable[[pd.Series], np.ndarray], dim: int) -> Callable:
    """UDX3/MEM6 plug-in: ``fn(tokens) -> (n, dim)`` array, applied to Arrow
    batches with ``mapInArrow`` (e.g. a neural encoder).  Only the tokens become
    Python objects; the other columns pass as they are and the vectors of a
    batch are one flat array."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = np.ascontiguousarray(fn(b.column("token").to_pandas()), dtype=np.float64).reshape(b.num_rows, dim)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(dim))
            vec = pa.ListArray.from_arrays(ends, pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, vec], [*b.schema.names, "vec"])

    def apply(df: DataFrame) -> DataFrame:
        schema = T.StructType(list(df.schema.fields) + [T.StructField("vec", T.ArrayType(T.DoubleType()))])
        return df.mapInArrow(run, schema)

    return apply


def summaries(tokens: DataFrame, keys: list[str], pos: str = "pos", vec: str = "vec",
              encoder=None, token: str = "token") -> DataFrame:
    """MEM8: document summary = vector of the last real token (by position);
    a document without tokens has no row (masked out).

    With a per-token ``encoder`` (Column -> Column) the last token is found
    first and only it is encoded: the aggregate shuffles one string per
    partial group instead of one vector, and the encoder runs once per
    document instead of once per token."""
    if encoder is not None:
        last = tokens.groupBy(*keys).agg(F.max_by(token, pos).alias("_t"), F.count(F.lit(1)).alias("n_tokens"))
        return last.select(*keys, encoder(F.col("_t")).alias("summary"), "n_tokens")
    return tokens.groupBy(*keys).agg(F.max_by(vec, pos).alias("summary"), F.count(F.lit(1)).alias("n_tokens"))


# --- MEM1-MEM5: keyed store ------------------------------------------------------

def add_entries(store: DataFrame, new: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """MEM1: add or replace entries; within ``new`` the highest version of a
    key wins (min-aggregate of a struct, no per-key window)."""
    cols = [c for c in new.columns if c not in (key, version)]
    best = new.groupBy(key).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in cols])).alias("_b")) \
              .select(key, F.col(f"_b.{version}").alias(version), *[F.col(f"_b.{c}").alias(c) for c in cols])
    kept = store.join(best.select(key), key, "left_anti")
    return kept.unionByName(best, allowMissingColumns=True)


def get_entries(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """MEM2: entries for an id list; absent ids come back with NULLs."""
    return ids.select(key).join(store, key, "left")


def remove_entries(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """MEM3: ``(store without ids, found flags per requested id)``."""
    present = store.select(key).distinct().withColumn("found", F.lit(True))
    found = ids.select(key).join(present, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))
    return store.join(ids.select(key), key, "left_anti"), found


def size_and_membership(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """MEM4: membership flag per id (``__contains__``); ``len`` is a count."""
    return remove_entries(store, ids, key)[1].withColumnRenamed("found", "contains")


def glob_to_regex(pattern: str) -> str:
    return fnmatch.translate(pattern)


def by_scope(store: DataFrame, prefix: str | None = None, glob: str | None = None,
             predicate: Column | None = None, path_col: str = "path") -> DataFrame:
    """MEM5: entries in a scope: path prefix, glob, and/or a metadata predicate."""
    df = store
    if prefix is not None:
        df = df.filter(F.col(path_col).startswith(prefix))
    if glob is not None:
        df = df.filter(F.col(path_col).rlike(glob_to_regex(glob)))
    if predicate is not None:
        df = df.filter(predicate)
    return df


# --- MEM9: incremental refresh -----------------------------------------------------

def refresh_plan(current_docs: DataFrame, store: DataFrame, key: str = "doc_id", text: str = "text"
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MEM9: which documents to (re-)encode.

    Returns ``(to_encode, kept, dropped)``: documents whose ``sha2`` content
    hash is new or changed, stored entries still valid, and stored entries
    whose document disappeared.  Only ``to_encode`` goes to the encoder.
    Ids and hashes alone are compared; a text moves only if it is to be encoded.
    """
    cur = current_docs.select(key, F.sha2(F.col(text), 256).alias("content_hash"))
    old = store.select(key, F.col("content_hash").alias("_old_hash"))
    changed = cur.join(old, key, "left").filter(F.col("_old_hash").isNull() | (F.col("_old_hash") != F.col("content_hash")))
    mine = F.sha2(F.col(text), 256)
    to_encode = current_docs.select(key, text, mine.alias("content_hash")).join(
        changed.select(key, "content_hash").distinct(), [key, "content_hash"], "left_semi").select(key, text, "content_hash")
    kept = store.join(cur.select(key, F.col("content_hash").alias("_h")), key, "inner") \
                .filter(F.col("_h") == F.col("content_hash")).drop("_h")
    dropped = store.join(cur.select(key), key, "left_anti")
    return to_encode, kept, dropped


# --- MEM11: compression --------------------------------------------------------------

def quantize(vec: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    """MEM11: per-vector max-abs scale; returns (codes, scale, dequantized)."""
    qmax = float((1 << (bits - 1)) - 1)
    scale = F.aggregate(vec, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))) / qmax
    safe = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    codes = F.transform(vec, lambda x: F.bround(x / safe, 0).cast("int"))
    deq = F.transform(codes, lambda c: c * safe)
    return codes, scale, deq


def quantization_error(vec: Column, deq: Column) -> tuple[Column, Column]:
    """Max absolute and mean squared reconstruction error of one vector."""
    diffs = F.zip_with(vec, deq, lambda a, b: a - b)
    mx = F.aggregate(diffs, F.lit(0.0), lambda acc, d: F.greatest(acc, F.abs(d)))
    mse = F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d) / F.size(vec)
    return mx, mse


# 4-bit codes, packed: two codes a byte, low half first, each code plus 8

def pack4(codes: Column, dim: int) -> Column:
    """Codes of ``quantize(..., bits=4)`` as ``(dim + 1) / 2`` bytes."""
    def half(i: int) -> Column:
        return F.coalesce(F.get(codes, F.lit(i)), F.lit(0)) + 8

    pieces = [F.lpad(F.hex((half(i) + half(i + 1) * 16).cast("bigint")), 2, "0") for i in range(0, dim, 2)]
    return F.unhex(F.concat(*pieces))


def packed_dot(packed: Column, query_codes: Column, dim: int) -> Column:
    """Whole-number product of a packed vector and integer query codes.

    Eight codes are cut from a 32-bit word by shifts and masks: neither an array nor a
    double is made of them, and the sum is one expression of generated code."""
    total: Column = F.lit(0).cast("bigint")
    for at in range(0, dim, 8):
        n = min(8, dim - at)
        word = F.conv(F.hex(F.substring(packed, at // 2 + 1, (n + 1) // 2)), 16, 10).cast("bigint")
        size = (n + 1) // 2
        for k in range(n):  # bytes come highest first
            shift = 8 * (size - 1 - k // 2) + 4 * (k % 2)
            total = total + (F.shiftright(word, shift).bitwiseAND(15) - 8) * F.get(query_codes, F.lit(at + k))
    return total


def packed_scores(store: DataFrame, queries: DataFrame, dim: int, group: str = "group_id") -> DataFrame:
    """MEM11: scores of packed keys (``packed, scale, l1``) against 8-bit queries (``codes, qscale, q1``) of their group,
    with a bound of the error: half a step of the key times the query's size, and half a step of the query
    times the decoded key's."""
    j = store.join(queries, group)
    score = packed_dot(F.col("packed"), F.col("codes"), dim) * F.col("scale") * F.col("qscale")
    bound = F.col("scale") / 2 * F.col("q1") + F.col("qscale") / 2 * F.col("l1")
    return j.select(group, "query_id", "doc_id", score.alias("score"), bound.alias("bound"))
