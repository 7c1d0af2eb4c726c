"""Token rows, padding and batches (TOK1-TOK6, UDX3).

Tokenisation is pluggable: the default is whitespace splitting with hashed
ids (no vocabulary, no shuffle) or a vocabulary join; any Python tokenizer
can be plugged in as an Arrow-batched ``pandas_udf``.  Batches are built
with a skew-safe global sequence number; padding widths come from a window
over one batch (``batch_size`` rows, bounded).
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.ordering import seq_number

PAD_ID = 0
IGNORE_INDEX = -100


def hashed_ids(text: Column, vocab_size: int = 50000, reserved: int = 2) -> Column:
    """TOK1 default: split on single spaces, id = reserved + md5(word) mod V."""
    return F.transform(F.split(text, " "), lambda w: (
        F.lit(reserved) + F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"),
                                 F.lit(vocab_size - reserved))).cast("int"))


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def vocab_ids(docs: DataFrame, vocab: DataFrame, text_col: str = "text", key: str = "doc_id",
              unk_id: int = 1) -> DataFrame:
    """TOK1 with a vocabulary ``(token, id)``: explode, join, re-assemble in
    position order (the group is one document)."""
    w = docs.select(key, F.posexplode(F.split(text_col, " ")).alias("pos", "token"))
    j = w.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(unk_id)))
    return j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p")) \
        .select(key, F.transform("_p", lambda x: x["id"]).alias("input_ids"))


def build_vocab(docs: DataFrame, text_col: str = "text", min_count: int = 1, reserved: int = 2) -> DataFrame:
    """Vocabulary of whitespace tokens with dense ids (frequency desc,
    token asc), numbered by the skew-safe global sequence."""
    counts = (docs.select(F.explode(F.split(text_col, " ")).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))
    numbered = seq_number(counts, [], [F.col("n").desc(), F.col("token")], name="_rank")
    return numbered.select("token", (F.col("_rank") - 1 + reserved).cast("int").alias("id"), "n")


def pandas_tokenizer(fn: Callable[[str], list[int]]):
    """UDX3: wrap any Python tokenizer as an Arrow-batched pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tok(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: list(fn(s)) if s is not None else None)

    return tok


def pad_to(ids: Column, length: int | Column, pad: int = PAD_ID, left: bool = False) -> tuple[Column, Column]:
    """TOK2: pad (or truncate) ``ids`` to ``length``; returns (ids, mask)."""
    ln = length if isinstance(length, Column) else F.lit(length)
    cut = F.slice(ids, 1, ln)
    fill = F.greatest(ln - F.size(cut), F.lit(0))
    pads = F.array_repeat(F.lit(pad), fill)
    ones = F.array_repeat(F.lit(1), F.size(cut))
    zeros = F.array_repeat(F.lit(0), fill)
    if left:
        return F.concat(pads, cut), F.concat(zeros, ones)
    return F.concat(cut, pads), F.concat(ones, zeros)


def chunk_rows(df: DataFrame, keys: list[str], ids: str, chunk_len: int) -> DataFrame:
    """One row per ``chunk_len`` slice of an id array: explode the chunk
    starts (plain generator) and slice in a following projection, so the
    exploded value is never a lambda result."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(chunk_len))
    return (df.select(*keys, ids, F.explode(starts).alias("_start"))
            .select(*keys, (F.col("_start") / chunk_len).cast("bigint").alias("chunk_idx"),
                    F.slice(F.col(ids), F.col("_start") + 1, chunk_len).alias("chunk")))


def assign_batches(df: DataFrame, batch_size: int, order: list[Column], partition: list[str] | None = None,
                   key: list[str] | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """TOK3: ``batch_id = (row_number - 1) div batch_size`` per partition key
    (e.g. split), numbered without a single-partition window.

    With a unique row ``key`` only the key and ``order_cols`` are numbered
    and the batch ids are joined back, so wide rows (token arrays) are not
    range-shuffled and checkpointed by the numbering."""
    keys = partition or []
    if key:
        cols = list(dict.fromkeys(keys + key + (order_cols or [])))
        n = seq_number(df.select(*cols), keys, order, name="_rn")
        ids = n.select(*dict.fromkeys(keys + key),
                       F.floor((F.col("_rn") - 1) / batch_size).cast("bigint").alias("batch_id"),
                       ((F.col("_rn") - 1) % batch_size).cast("int").alias("batch_pos"))
        return df.join(ids, list(dict.fromkeys(keys + key)))
    n = seq_number(df, keys, order, name="_rn")
    return n.withColumn("batch_id", F.floor((F.col("_rn") - 1) / batch_size).cast("bigint")) \
            .withColumn("batch_pos", ((F.col("_rn") - 1) % batch_size).cast("int")).drop("_rn")


def collate(df: DataFrame, batch_keys: list[str], question_side: str = "left", pad: int = PAD_ID) -> DataFrame:
    """TOK3 + TOK4: pad questions (left or right), answers (right) and the
    chunk lists to the batch maxima; all-zero masks for padded chunks.

    Input columns: ``context_ids array<array<int>>``, ``question_ids``,
    ``answer_ids``.  Batch maxima are aggregates of sizes; only they are joined to the
    rows, so where they are small no array is shuffled.
    """
    longest = F.array_max(F.transform("context_ids", lambda c: F.size(c)))
    most = df.groupBy(*batch_keys).agg(
        F.max(F.size("question_ids")).alias("_qmax"), F.max(F.size("answer_ids")).alias("_amax"),
        F.max(F.size("context_ids")).alias("_cmax"), F.max(F.coalesce(longest, F.lit(0))).alias("_lmax"))
    df = df.join(most, batch_keys)
    q_ids, q_mask = pad_to(F.col("question_ids"), F.col("_qmax"), pad, left=(question_side == "left"))
    a_ids, a_mask = pad_to(F.col("answer_ids"), F.col("_amax"), pad)
    chunk_ids = F.transform("context_ids", lambda c: pad_to(c, F.col("_lmax"), pad)[0])
    chunk_mask = F.transform("context_ids", lambda c: pad_to(c, F.col("_lmax"), pad)[1])
    extra = F.greatest(F.col("_cmax") - F.size("context_ids"), F.lit(0))
    blank_ids = F.array_repeat(F.array_repeat(F.lit(pad), F.col("_lmax")), extra)
    blank_mask = F.array_repeat(F.array_repeat(F.lit(0), F.col("_lmax")), extra)
    return df.select(
        "*",
        F.concat(chunk_ids, blank_ids).alias("context_input_ids"),
        F.concat(chunk_mask, blank_mask).alias("context_attention_mask"),
        q_ids.alias("question_input_ids"), q_mask.alias("question_mask"),
        a_ids.alias("answer_input_ids"), a_mask.alias("answer_mask"),
    ).drop("_qmax", "_amax", "_cmax", "_lmax")


def teacher_forcing(question_ids: Column, answer_ids: Column, answer_mask: Column | None = None
                    ) -> tuple[Column, Column]:
    """TOK5: ``input = question ++ answer``; labels ignore the question and
    (fix) padded answer positions."""
    ids = F.concat(question_ids, answer_ids)
    if answer_mask is None:
        ans = answer_ids
    else:
        ans = F.zip_with(answer_ids, answer_mask, lambda a, m: F.when(m == 1, a).otherwise(F.lit(IGNORE_INDEX)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(question_ids)), ans)
    return ids, labels


def shifted_loss(rows: DataFrame, keys: list[str], pos: str = "pos", label: str = "label",
                 logp: str = "logp") -> DataFrame:
    """TOK6: masked mean negative log-likelihood with a one-position shift.

    ``rows``: one row per (sequence, position) with the label at that
    position and the model's log-probability table flattened as
    ``logp`` = log p(token at pos+1 | prefix up to pos).  Position ``t``
    predicts ``label[t+1]``; positions whose next label is -100 (or absent)
    are ignored.  Per-sequence ``lead`` works inside one sequence.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    nxt = rows.withColumn("_next", F.lead(label).over(w))
    valid = nxt.filter(F.col("_next").isNotNull() & (F.col("_next") != IGNORE_INDEX))
    return valid.groupBy(*keys).agg(F.avg(-F.col(logp)).alias("loss"), F.count(F.lit(1)).alias("n_tokens"))
