"""Benchmark decontamination by winnowing.

A window of ``L`` consecutive words is keyed by its fingerprint: the least hash
of the k-grams inside it.  The fingerprint depends on nothing but the window,
so a span of ``L`` words shared by a document and an item always has the same
fingerprint on both sides (the winnowing guarantee), and since neighbouring
windows mostly share their least k-gram, a document has about ``2 / (L-k+2)``
runs of fingerprints per word.  One row per run goes to the join with the
fingerprints of the test items; the windows of the runs that hit are then
extended to whole windows by the hash of all their words.

A window is named by two 64-bit hashes together, its fingerprint and the hash of all its words:
two windows are taken for equal only if they agree in both, that is if they
share their least k-gram and collide besides.

Fingerprints and windows of the items are distinct tables, kept once: a passage in many
items or many documents multiplies nothing.  Documents that hit the same set
of windows are named once.  The item side is broadcast only after its rows
were counted against ``BROADCAST_ROWS``; above it the joins shuffle.

Items shorter than ``WINDOW`` words are one window of their own length.

Defined cases: null or empty texts have no words and no hits; items without a
word match nothing; repeated documents and items each give their own row (an
item id listed once); null ``doc_id`` is a key like any other; empty tables
give no rows or no hits; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import keep

WINDOW = 10
GRAM = 5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
RUNS = "array<struct<length:int,fp:bigint,start:int,windows:array<bigint>>>"


def item_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_runs(hashes: Column, n: Column, length: int) -> Column:
    """Runs of neighbouring windows with one fingerprint: ``array<struct<length,
    fp, start, windows array<bigint>>>``; a window is the hash of its words."""
    k = GRAM if length >= GRAM else 1
    span = length - k + 1  # k-grams in a window
    none = F.array().cast(RUNS)

    def gram(h: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + j) for j in range(k)])

    def runs(g: Column) -> Column:
        # g holds n-k+1 grams; windows start at 0 .. n-length
        last = F.size(g) - span
        least = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(g, i + 1, span)))
        # a window's words are covered by the grams at every k-th place and the last
        at = sorted({*range(0, span, k), span - 1})
        whole = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(g, i + j) for j in at]))

        def cut(m: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), last),
                              lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))

            def rows(s: Column) -> Column:
                return F.transform(s, lambda b, j: F.struct(b.alias("b"), F.coalesce(F.get(s, j + 1), last + 1).alias("e"),
                                                            F.get(m, b).alias("fp")))

            return _bind(starts, rows)

        cuts = _bind(least, cut)
        return _bind(whole, lambda w: F.transform(cuts, lambda c: F.struct(
            F.lit(length).alias("length"), c["fp"].alias("fp"), c["b"].alias("start"), F.slice(w, c["b"] + 1, c["e"] - c["b"]).alias("windows"))))

    def from_hashes(h: Column) -> Column:
        grams = h if k == 1 else F.transform(F.sequence(F.lit(0), n - k), lambda i: gram(h, i))
        return _bind(grams, runs)

    return F.when(n >= length, _bind(hashes, from_hashes)).otherwise(none)


def _hashed(df: DataFrame, keys: list[Column]) -> DataFrame:
    return (df.select(*keys, item_words(F.col("text")).alias("_w"))
            .select(*[F.col(k) for k in df.select(*keys).columns],
                    F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), F.size("_w").alias("n_words")))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct ``(length, fp, win, item_id)`` of the test items."""
    h = _hashed(items, [F.col("item_id").cast("string").alias("item_id")]).where("n_words > 0")
    n = F.col("n_words")
    runs = F.when(n >= WINDOW, window_runs(F.col("_h"), n, WINDOW))
    for length in range(1, WINDOW):
        runs = F.when(n == length, window_runs(F.col("_h"), n, length)).otherwise(runs)
    return (h.select("item_id", F.inline(runs)).select("item_id", "length", "fp", F.explode("windows").alias("win"))
            .distinct())


def find_hits(docs: DataFrame, items: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Every occurrence of an item's window in a document: ``doc_id, text_hash,
    length, fp, win, start`` (distinct)."""
    windows = item_windows(items) if windows is None else windows
    sizes = {r[0]: r[1] for r in windows.groupBy("length").count().collect()}  # at most WINDOW rows
    n_windows = sum(sizes.values())
    own = _hashed(docs, [F.col("doc_id"), F.xxhash64("text").alias("text_hash")])
    runs = [window_runs(F.col("_h"), F.col("n_words"), length) for length in sorted(sizes)] or [F.array().cast(RUNS)]
    rows = own.select("doc_id", "text_hash", F.inline(F.concat(*runs)))
    prints = windows.select("length", "fp").distinct()
    exact = windows.select("length", "fp", "win").distinct()
    near = rows.join(_small(prints, n_windows), ["length", "fp"], "left_semi")
    places = near.select("doc_id", "text_hash", "length", "fp", "start", F.posexplode("windows").alias("j", "win"))
    hits = places.join(_small(exact, n_windows), ["length", "fp", "win"], "left_semi")
    return hits.select("doc_id", "text_hash", "length", "fp", "win", (F.col("start") + F.col("j")).alias("start"))


def mark_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items
    array<string>, contaminated``."""
    windows = keep(item_windows(items), "leak-windows")
    # read by two branches: the winnowing of all documents is planned once
    hits = keep(find_hits(docs, items, windows), "leak-hits")
    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.struct("length", "fp", "win"))).alias("wins"))
    walked = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end")))
    by_doc = by_doc.select("doc_id", "text_hash", walked["n"].alias("n_hit"), "wins",
                           F.sha2(F.to_json("wins"), 256).alias("sig"))
    # one row per distinct set of windows, however many documents have it
    sets = by_doc.groupBy("sig").agg(F.any_value("wins").alias("wins"))
    named = (sets.select("sig", F.explode("wins").alias("w")).select("sig", "w.length", "w.fp", "w.win")
             .join(windows, ["length", "fp", "win"]).groupBy("sig").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    found = by_doc.join(named, "sig").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "n_hit", "items")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                      F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"))
    out = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (own["text_hash"] == found["_th"]), "left")
    return out.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    windows = keep(item_windows(items), "leak-windows")
    hit = find_hits(docs, items, windows).select("doc_id", "text_hash").distinct()
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_th"))
    return own.join(hit, same, "left_anti").select("_doc.*")
