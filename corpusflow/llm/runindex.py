"""Repeated strings by run-length indexes, one for each group of similar places.

Every window of ``length`` bytes is keyed by the least hash of the k-grams in
it, a value that depends on the window's bytes alone.  Neighbouring windows
mostly share it, so a text falls into fragments (runs of windows with one key,
with the bytes they cover), about one for each 200 bytes.  Equal windows always
have equal keys: whatever repeats, repeats inside one key's fragments, and keys
can be dealt to tasks.

Equal fragments (by a 128-bit digest) are counted first, combined before the
shuffle: all windows of a fragment that occurs twice are repeats.  Keys with
one fragment need nothing more, unless the fragment has its least k-gram twice
(a periodic text can repeat a window inside one run).  For the rest one representative of each
fragment goes to the task of its key, which builds a run-compressed
Burrows-Wheeler transform over a chunk of whole keys:

* runs of the transform, with the text positions of their first and last rows
  as samples (:func:`run_samples`);
* the longest common prefixes across run borders, the only ones that are not
  the neighbour's less one;
* matching statistics, streamed over the text from sample to sample: the
  longest string that starts here and also starts elsewhere
  (:func:`matching_statistics`).

Windows whose statistic reaches ``length`` are marked.  A key with more than
``GROUP`` fragments (a common passage in a third of all documents) is keyed
anew by the least hashes of 4, then 16 parts of the window, at last by the whole
window, where a fragment is one window, or that window several times over (a run
of one byte): its print is the window's, its windows are counted, and nothing is
left to index.  So no task holds more than ``GROUP`` fragments of a key, whatever
the skew.

Defined cases: null text is empty; texts shorter than ``length`` have no window;
equal rows are documents of their own, so all their windows repeat; a null
``doc_id`` is a key like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import keep

LENGTH = 400
GROUP = 2_000
#: parts of a window that are keyed apart, level by level; 0 is the whole window
LEVELS = (1, 4, 16, 0)
BLOCK = 1 << 20
CHUNK = 1 << 20
RUN_LIMIT = 1_024
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every place on."""
    power, size = {1: _BYTE[data]}, 1
    while size * 2 <= k:
        h, p = power[size], np.uint64(pow(int(_PRIME), size, 1 << 64))
        power[size * 2] = h[:-size] * p + h[size:] if len(h) > size else h[:0]
        size *= 2
    n = max(len(data) - k + 1, 0)
    out, at = np.zeros(n, np.uint64), 0
    for s in sorted(power, reverse=True):
        if k - at >= s:
            out = out * np.uint64(pow(int(_PRIME), s, 1 << 64)) + power[s][at:at + n]
            at += s
    return _mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, in two passes over blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def window_keys(data: np.ndarray, length: int, parts: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The key of the window at every place; for one part also the place of the
    least k-gram, or -1 where the window has it twice."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), None
    if not parts:
        return gram_hashes(data, length), None
    size = length // parts
    k = max(min(32, size // 2), 1)
    grams = gram_hashes(data, k)
    if parts == 1:
        low = np.uint64((1 << 32) - 1)  # ordered by the upper half of the hash, then by place
        at = np.arange(len(grams), dtype=np.uint64)
        left = sliding_min((grams & ~low) | at, size - k + 1)
        right = sliding_min((grams & ~low) | (low - at), size - k + 1)
        place = (left & low).astype(np.int64)
        key = _mix(grams[place])
        place[(left & low) != low - (right & low)] = -1
        return key, place
    least = sliding_min(grams, size - k + 1)
    key = np.zeros(n, np.uint64)
    for j in range(parts):
        key = _mix(key + least[j * size:j * size + n])
    return key, None


def fragments(texts: list[bytes], length: int, parts: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: text number, first window, windows, key, and
    whether two windows of the run could be equal."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    key, place = window_keys(data, length, parts)
    empty = np.empty(0, np.int64)
    if not len(key):
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, bool)
    owner = np.repeat(np.arange(len(texts)), size)[:len(key)]
    whole = np.arange(len(key)) + length <= (begin + size)[owner]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(key)))
    if place is not None:  # equal windows have their least k-gram at different places
        odd = place < 0
        odd[1:] |= (place[1:] != place[:-1]) & ~new[1:]
        twice = np.logical_or.reduceat(odd, head)
    else:  # equal windows begin with equal k-grams
        run, gram = np.cumsum(new), gram_hashes(data, min(32, length))[:len(key)]
        order = np.lexsort((gram, run))
        same = order[1:][(run[order][1:] == run[order][:-1]) & (gram[order][1:] == gram[order][:-1])]
        twice = np.isin(np.arange(len(head)), run[same] - 1)
    head, n, twice = head[whole[head]], n[whole[head]], twice[whole[head]]
    cuts = -(-n // RUN_LIMIT)  # periodic texts have runs without end
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    head = np.repeat(head, cuts) + nth * RUN_LIMIT
    n = np.minimum(np.repeat(n, cuts) - nth * RUN_LIMIT, RUN_LIMIT)
    doc = owner[head]
    return doc, head - begin[doc], n, key[head], np.repeat(twice, cuts)


# ---- the index of one chunk ----

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only places that are still tied are sorted on."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text + 1  # the end is less than any symbol
    word = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits for each of seven symbols
        word = (word << np.uint64(9)) | wide[j:j + n]
    sa = np.argsort(word, kind="stable")
    sorted_words = word[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    depth = 7
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return sa
        place = sa[tied]
        follow = rank[np.minimum(place + depth, n)]
        order = np.lexsort((follow, start[tied]))
        place, follow, group = place[order], follow[order], start[tied]
        sa[tied] = place
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[tied] = fresh
        start[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[place] = start[tied]
        depth *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``."""
    n = len(text)
    padded = np.full(n + 8, 511, np.uint64)
    padded[:n] = text
    word = np.zeros(n + 1, np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | padded[j:j + n + 1]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (np.maximum(x, y) < n - 7) & (out[live] < most)
        same = inside & (word[np.minimum(x, n)] == word[np.minimum(y, n)])
        out[live[same]] += 7
        rest = live[~same]
        for _ in range(7):  # the last symbols one by one
            x, y = a[rest] + out[rest], b[rest] + out[rest]
            ok = (x < n) & (y < n) & (x != y)
            ok &= padded[np.minimum(x, n)] == padded[np.minimum(y, n)]
            rest = rest[ok]
            out[rest] += 1
        live = live[same]
    return out


def run_samples(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text positions at the run borders of the Burrows-Wheeler transform: the
    last row of each run and the first row of the next."""
    bwt = np.where(sa > 0, text[sa - 1], -1)  # nothing stands before the first place
    border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    return sa[border - 1], sa[border]


def matching_statistics(text: np.ndarray, most: int) -> np.ndarray:
    """For every place the longest string that also starts elsewhere."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    tail, head = run_samples(text, suffix_array(text))
    lcp = common_prefix(text, tail, head, most)
    out = np.zeros(n, np.int64)
    for at in (head, tail):  # towards the row before, towards the row after
        reach = np.full(n, -1, np.int64)
        reach[at] = at + lcp  # falls by one at every place until the next sample
        sampled = np.zeros(n, np.int64)
        sampled[at] = at
        latest = np.maximum.accumulate(sampled)
        value = reach[latest] - np.arange(n)
        np.maximum(out, value, out=out)
    return out


def mark_chunk(frags: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Repeated windows of each fragment against all others: ``(first, stop)``."""
    size = np.array([len(f) + 1 for f in frags])
    text = np.zeros(size.sum(), np.int64)
    end = np.cumsum(size) - 1
    inside = np.ones(len(text), bool)
    inside[end] = False
    text[inside] = np.frombuffer(b"".join(frags), np.uint8).astype(np.int64) + 1
    stat = matching_statistics(text, int(size.max()))
    left = np.repeat(end, size) - np.arange(len(text))
    hit = np.minimum(stat, left) >= length
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in frags]
    for f, a, b in zip(np.searchsorted(end, first), first, stop):
        begin = int(end[f] - size[f] + 1)
        out[f].append((int(a) - begin, int(b) - begin))
    return out


# ---- Spark ----

DOC = ["key_id", "text_hash"]
FRAG = ["key", "print", "size", "seen", "start", "n"]
PLACE = "key_id string, text_hash bigint, start bigint, n bigint"


def cut_texts(rows: DataFrame, length: int, parts: int, carry: bool) -> DataFrame:
    """``rows(key_id, text_hash, at, seen, data)`` to fragments; ``carry`` keeps their bytes.
    Whole windows (no ``parts``) have the print of one window, however long the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = b["data"].tolist()
            size = np.cumsum([len(x) for x in data])
            for block in np.split(np.arange(len(b)), np.flatnonzero(np.diff(size // BLOCK)) + 1):
                texts = [data[i] for i in block]
                doc, first, n, key, twice = fragments(texts, length, parts)
                bits = [texts[d][a:a + m + length - 1] for d, a, m in zip(doc, first, n)]
                of = b.iloc[block[doc]] if len(doc) else b.iloc[:0]
                out = pd.DataFrame({
                    "key": key.astype(np.int64), "print": [xxhash.xxh3_128_digest(x if parts else x[:length]) for x in bits],
                    "key_id": of["key_id"].to_numpy(), "text_hash": of["text_hash"].to_numpy(),
                    "start": of["at"].to_numpy(np.int64) + first, "n": n, "seen": of["seen"].to_numpy(),
                    "twice": twice})
                if carry:
                    out["data"] = bits
                yield out

    schema = f"key bigint, print binary, {PLACE}, seen boolean, twice boolean" + (", data binary" if carry else "")
    return rows.mapInPandas(run, schema)


def _spans(rows: DataFrame, length: int) -> DataFrame:
    return rows.select(*DOC, F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))


def index_groups(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows in the fragments that were met once, by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def work(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for i, runs in enumerate(mark_chunk(b["data"].tolist(), length)):
                if not b["seen"].iat[i]:
                    at = int(b["start"].iat[i])
                    out += [(b["key_id"].iat[i], b["text_hash"].iat[i], at + x, at + y + length - 1) for x, y in runs]
            return pd.DataFrame(out, columns=["key_id", "text_hash", "s", "e"])

        def whole_keys(last: bool) -> Iterator[pd.DataFrame]:
            b = pd.concat(held, ignore_index=True)
            held.clear()
            keys = b["key"].to_numpy()
            border = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            size = np.cumsum(b["data"].map(len).to_numpy())
            begin = 0
            for i, stop in enumerate(border):
                final = i + 1 == len(border)
                if final and not last:
                    break
                if final or size[stop - 1] - (size[begin - 1] if begin else 0) >= CHUNK:
                    yield work(b.iloc[begin:stop])
                    begin = stop
            if begin < len(b):
                held.append(b.iloc[begin:])

        waiting = 0
        for b in batches:
            if len(b):
                held.append(b)
                waiting += int(b["data"].map(len).sum())
            if waiting >= 2 * CHUNK:
                yield from whole_keys(False)
                waiting = sum(int(h["data"].map(len).sum()) for h in held)
        if held:
            yield from whole_keys(True)

    ranged = rows.repartition("key").sortWithinPartitions("key", "print")
    return ranged.select("key", "key_id", "text_hash", "start", "seen", "data").mapInPandas(
        run, "key_id string, text_hash bigint, s bigint, e bigint")


def _grouped(frags: DataFrame, length: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Spans of fragments that are repeated whole, and one representative of
    every fragment of the keys that need an index (``seen``: repeated whole)."""
    copies = F.count(F.lit(1)) if parts else F.sum("n")  # a run of whole windows repeats in itself
    first = F.min(F.struct("key_id", "text_hash", "start", "n")).alias("at")
    prints = frags.groupBy("key", "print").agg(copies.alias("copies"), F.max("seen").alias("met"),
                                             F.max("twice").alias("twice"), first)
    prints = prints.withColumn("seen", F.col("met") | (F.col("copies") > 1))
    whole = prints.where("seen").select("key", "print")
    spans = _spans(frags.where("not seen").join(whole, ["key", "print"], "left_semi"), length)
    keys = (prints.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("seen").alias("all_seen"),
                                          F.max(F.col("twice") & ~F.col("seen")).alias("own"))
            .where("size > 1 and not all_seen or own").select("key", "size"))
    chosen = prints.join(keys, "key").select("key", "print", "size", "seen", "at.*")
    return spans, chosen


def _bytes_of(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The chosen fragments with their bytes; a text is met once for all of its fragments."""
    lists = chosen.groupBy(*DOC).agg(F.collect_list(F.struct(*FRAG)).alias("frags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = pc.list_parent_indices(b.column("frags"))
            flat = dict(zip(FRAG, pc.list_flatten(b.column("frags")).flatten()))
            data = b.column("data").to_pylist()
            bits = [data[d][s:s + n + length - 1] for d, s, n in zip(*(x.to_pylist() for x in (owner, flat["start"], flat["n"])))]
            yield pa.RecordBatch.from_arrays(
                [*(flat[c] for c in FRAG), *(b.column(c).take(owner) for c in DOC), pa.array(bits, pa.binary())],
                names=[*FRAG, *DOC, "data"])

    same = docs.join(lists, DOC).select(*DOC, "frags", "data")
    return same.mapInArrow(run, "key bigint, print binary, size bigint, seen boolean, start bigint, n bigint, "
                                "key_id string, text_hash bigint, data binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key_id, text_hash, s, e``: byte spans covered by repeated strings.
    ``docs`` has ``key_id, text_hash, data``."""
    whole_docs = docs.select(*DOC, F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("seen"), "data")
    frags = keep(cut_texts(whole_docs, length, LEVELS[0], False), "runs-frags")
    spans, chosen = _grouped(frags, length, LEVELS[0])
    spans = [spans]
    chosen = keep(_bytes_of(docs, chosen, length), "runs-chosen")
    for parts in LEVELS[1:]:
        spans.append(index_groups(chosen.where(F.col("size") <= GROUP), length))
        large = chosen.where(F.col("size") > GROUP)
        if not large.take(1):
            break
        again = large.select(*DOC, F.col("start").alias("at"), "seen", "data")
        frags = keep(cut_texts(again, length, parts, True), "runs-frags")
        more, chosen = _grouped(frags, length, parts)
        spans.append(more)
        if not parts:  # every window is counted
            break
        chosen = keep(chosen.join(frags.select("key", "print", *DOC, "start", "data"), ["key", "print", *DOC, "start"]),
                      "runs-chosen")
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the remaining bytes)
    and ``spans`` (maximal removed runs) of every row."""
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("key_id"), F.xxhash64("text").alias("text_hash"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    spans = repeated_spans(own, length).groupBy(*DOC).agg(
        F.flatten(F.sort_array(F.collect_set(F.array("s", "e")))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key_id, data, spans in zip(b["key_id"], b["data"], b["spans"]):
                runs: list[list[int]] = []
                if spans is not None:
                    for s, e in np.asarray(spans).reshape(-1, 2).tolist():
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rows.append((key_id, len(data), sum(e - s for s, e in runs), len(runs), b"".join(kept), runs))
            yield pd.DataFrame(rows, columns=["key_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    out = own.join(spans, DOC, "left").select("key_id", "data", "spans").mapInPandas(
        run, "key_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<array<bigint>>")
    doc_id = F.when(F.col("key_id") != "~", F.col("key_id")).cast(docs.schema["doc_id"].dataType)
    return out.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "spans")
