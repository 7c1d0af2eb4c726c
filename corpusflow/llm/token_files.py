"""Token files compressed by Re-Pair grammars.

Documents are ranged by ``(doc_id, digest of the text)`` over partitions and
sorted inside them, so the files taken in order hold ascending ids.  A task
encodes its documents, cuts them into shards of about ``SHARD_IDS`` ids and
compresses each by itself: the frequent pairs of neighbouring ids are replaced
by new symbols, again and again, until no pair occurs ``MIN_COUNT`` times; a pair never
reaches over a document's end.  In one round every frequent pair gets its rule,
and where pairs overlap the more frequent one is taken.

A shard file holds, little-endian::

    "RPG1", u32 first rule symbol, u64 rules, u64 symbols, u64 documents
    rules    u32 left, u32 right             one for each rule
    lengths  u64                             ids that a rule stands for
    symbols  u32                             the compressed sequence
    docs     i64 doc_id, u8 has_id, u64 first symbol, u64 first id, u64 ids
    u32      crc32 of everything before

The lengths let a reader find the symbols that cover any range of ids and
expand only those (:meth:`Shard.ids`).

A file's name is new for every attempt of a task, and only the names that
finished tasks return are in the manifest, so a lost executor leaves at most
unread files.  ``start`` comes from the manifest: sums of the shards inside a
partition and of the partitions, one row each.

Defined cases: null text is empty (the end id alone); null ``doc_id`` sorts
first; equal ids are ordered by the digest of their text; other columns are
ignored; an empty table writes nothing and reads as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import keep, shared_path
from corpusflow.llm.encoding import word_encoder
from corpusflow.llm.files import read_file, write_file

SHARD_IDS = 1 << 20
READ_TASKS = 10_000
MIN_COUNT = 8
#: up to so many pairs are counted exactly, more of them in buckets
EXACT = 1 << 14
HEAD = struct.Struct("<4sIQQQ")
DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("symbol", "<u8"), ("start", "<u8"), ("n", "<u8")])
_BUCKET_BITS = 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _counted(code: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, count, known)`` of every pair: a number for its kind, how often it is there, and
    whether the count holds.  Many pairs are counted in buckets of a hash that differs in
    every round; a bucket stands for one of its pairs, the others get their turn later."""
    if len(code) <= EXACT:
        _, name, count = np.unique(code, return_inverse=True, return_counts=True)
        return name, count[name], np.ones(len(code), bool)
    hashed = code.view(np.uint64) * np.uint64(_ODD[turn % len(_ODD)])
    bucket = (hashed >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
    pair_of = np.empty(1 << _BUCKET_BITS, np.int64)
    pair_of[bucket] = code
    known = pair_of[bucket] == code
    count = np.bincount(bucket[known], minlength=1 << _BUCKET_BITS)
    return bucket, np.where(known, count[bucket], 0), known


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard.  ``ends`` marks the last id of a document.
    Returns rules (n, 2), their lengths, the symbols and the marks of the
    symbols that end a document.

    Pairs of old symbols only get fewer, so a place whose pair is known to be rare is
    never looked at again: after the first rounds the work is on the places next to new
    symbols and on frequent pairs that lost to an overlapping one."""
    seq, ends = ids.astype(np.int32), ends.copy()
    rules: list[np.ndarray] = []
    lengths = np.ones(first_rule, np.uint64)
    n_rules = turn = 0
    active = np.flatnonzero(~ends[:-1])
    while True:
        code = (seq[active].astype(np.int64) << 32) | seq[active + 1]
        name, count, known = _counted(code, turn)
        turn += 1
        often = count >= MIN_COUNT
        if not often.any():
            if known.all():
                break
            active = active[~known]
            continue
        # the more frequent pair comes first; rank[i + 1] is of place i
        rank = np.zeros(len(seq) + 2, np.int64)
        rank[active[often] + 1] = (count[often] << _BUCKET_BITS) | name[often]
        at = active[often]
        mine, before, after = rank[at + 1], rank[at], rank[at + 2]
        taken = (mine > before) & (mine >= after)
        # in a run of one symbol every other place is taken
        head = mine != before
        inner = np.flatnonzero(~head)
        if len(inner):
            heads = np.flatnonzero(head)
            offset = at[inner] - at[heads[np.searchsorted(heads, inner) - 1]]
            taken[inner] = (offset % 2 == 0) & (mine[inner] >= after[inner])
        kind = name[often]
        used = np.bincount(kind[taken], minlength=int(name.max()) + 1)
        taken &= used[kind] >= MIN_COUNT // 2
        place, kind = at[taken], kind[taken]
        first = np.full(len(used), -1)
        first[kind] = place  # any place of a kind shows its pair
        made = np.flatnonzero(first >= 0)
        rule = np.stack([seq[first[made]], seq[first[made] + 1]], 1)
        number = np.empty(len(used), np.int32)
        number[made] = np.arange(len(made), dtype=np.int32)
        number = number[kind]
        rules.append(rule)
        lengths = np.concatenate([lengths, lengths[rule[:, 0]] + lengths[rule[:, 1]]])
        seq[place] = first_rule + n_rules + number
        ends[place] = ends[place + 1]
        n_rules += len(made)
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        look = np.zeros(len(seq), bool)
        look[active[often | ~known]] = True
        look[place], look[place + 1] = True, False
        next_to = place[place > 0] - 1
        next_to -= ~stay[next_to]  # the symbol before is itself new
        look[next_to] = True
        seq, ends, look = seq[stay], ends[stay], look[stay]
        look[-1] = False
        look &= ~ends
        active = np.flatnonzero(look)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return table.astype("<u4"), lengths[first_rule:].astype("<u8"), seq.astype("<u4"), ends


def pack(doc_ids: list, ids: list[np.ndarray], first_rule: int) -> bytes:
    """One shard file."""
    n = np.array([len(x) for x in ids], np.uint64)
    flat = np.concatenate(ids)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(n).astype(np.int64) - 1] = True
    rules, lengths, seq, seq_ends = compress(flat, ends, first_rule)
    docs = np.zeros(len(n), DOC)
    docs["has_id"] = [x is not None for x in doc_ids]
    docs["doc_id"] = [x or 0 for x in doc_ids]
    docs["n"] = n
    docs["start"] = np.cumsum(n) - n
    docs["symbol"][1:] = np.flatnonzero(seq_ends)[:-1] + 1
    body = b"".join([HEAD.pack(b"RPG1", first_rule, len(rules), len(seq), len(docs)),
                     rules.tobytes(), lengths.tobytes(), seq.tobytes(), docs.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Shard:
    first_rule: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    docs: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> "Shard":
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("shard file: wrong checksum")
        magic, first_rule, n_rules, n_symbols, n_docs = HEAD.unpack_from(data)
        if magic != b"RPG1":
            raise ValueError("shard file: wrong magic")
        at = HEAD.size
        parts = []
        for dtype, n in (("<u4", 2 * n_rules), ("<u8", n_rules), ("<u4", n_symbols), (DOC, n_docs)):
            parts.append(np.frombuffer(data, dtype, n, at))
            at += parts[-1].nbytes
        return cls(first_rule, parts[0].reshape(-1, 2), *parts[1:])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: every rule writes its two halves to their places."""
        size = self.sizes(symbols).astype(np.int64)
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, "<u4")
        symbol, at = symbols, end - size
        while len(symbol):
            rule = symbol >= self.first_rule
            out[at[~rule]] = symbol[~rule]
            number, at = symbol[rule] - self.first_rule, at[rule]
            left, right = self.rules[number, 0], self.rules[number, 1]
            symbol, at = np.concatenate([left, right]), np.concatenate([at, at + self.sizes(left).astype(np.int64)])
        return out

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), np.uint64)
        rule = symbols >= self.first_rule
        out[rule] = self.lengths[symbols[rule] - self.first_rule]
        return out

    def doc(self, k: int) -> np.ndarray:
        stop = self.docs["symbol"][k + 1] if k + 1 < len(self.docs) else len(self.symbols)
        return self.expand(self.symbols[int(self.docs["symbol"][k]):int(stop)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any range of the shard's ids; only the covering symbols are expanded."""
        edge = np.cumsum(self.sizes(self.symbols)).astype(np.int64)
        a, b = np.searchsorted(edge, start, "right"), np.searchsorted(edge, stop, "left") + 1
        first = int(edge[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - first:stop - first]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write; the manifest ``part, seq, file, n_docs, n_ids`` is
    itself kept as a table in the shared folder."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_d", F.xxhash64("text"))
    ranged = own.repartitionByRange("doc_id", "_d").sortWithinPartitions("doc_id", "_d").select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_encoder(tokenizer)
        first_rule = max(known.tok.get_vocab_size(), end_id + 1)
        part, seq = TaskContext.get().partitionId(), 0
        held_ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            file = f"{path}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.rpg"
            write_file(file, pack(held_ids, held, first_rule))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [file], "n_docs": [len(held)], "n_ids": [size]})

        for b in batches:
            for doc_id, has_id, ids in zip(b.column("doc_id").to_pylist(), b.column("has_id").to_pylist(), known.ids(b.column("text"))):
                ids = np.append(ids, np.uint32(end_id))
                if held and size + len(ids) > shard_ids:
                    yield shard()
                    seq, held_ids, held, size = seq + 1, [], [], 0
                held_ids.append(doc_id if has_id else None)
                held.append(ids)
                size += len(ids)
        if held:
            yield shard()

    rows = ranged.mapInArrow(write, "part bigint, seq bigint, file string, n_docs bigint, n_ids bigint")
    return keep(rows, "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = (manifest.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
              .join(parts, "part").select("file", (F.col("part_start") + F.col("shard_start")).alias("base")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, base in zip(b["file"], b["base"]):
                shard = Shard.parse(read_file(file))
                docs = shard.docs
                ids = np.split(shard.expand(shard.symbols), docs["start"][1:].astype(np.int64))
                if [len(x) for x in ids] != docs["n"].tolist():
                    raise ValueError("shard file: lengths do not match")
                yield pd.DataFrame({
                    "doc_id": docs["doc_id"].astype(np.int64),
                    "has_id": docs["has_id"] == 1,
                    "start": base + docs["start"].astype(np.int64),
                    "n_tokens": [len(x) for x in ids],
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})

    # file names are small rows: without a number, all of them would be merged into one task
    rows = placed.repartition(min(max(manifest.count(), 1), READ_TASKS)).mapInPandas(
        read, "doc_id bigint, has_id boolean, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the token files below the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, tokenizer, end_id, path, shard_ids))
