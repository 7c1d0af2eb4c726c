"""Star-band census over a repository metadata snapshot (BND1-BND11).

The remote search is re-aimed as a range-partitioned census: every band of
the ladder is an equi (language) + range (stars) predicate.  The ladder is a
fixed-size dimension (at most 57 languages x 14 bands), so it is broadcast;
the snapshot is never shuffled for the band join.  Per-band totals are
partial aggregates; the optional per-band cap is a filter on sequence numbers
that are dealt over ranges of rows (:mod:`corpusflow.functions.ordering`).
The sequential rules of the reference (stop at the first empty band, stop
at the target, skip completed bands) become windows over the *band summary*
(one row per band): tiny by construction.  The limits of the remote search
(cap, target, early stop) are options that are off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions.ordering import seq_number

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical band plans).
# Result cap of one search query.
SEARCH_LIMIT = 1000
# Star cut points of the band ladder, high to low.
CUT_POINTS = (100000, 50000, 20000, 10000, 5000, 2000, 1000, 500, 200, 100, 50, 20, 10)
# Highest band start per language; unlisted languages start at 1000.
DEFAULT_START = 1000
START_THRESHOLDS = {
    "python": 100000, "javascript": 100000, "typescript": 50000, "java": 50000,
    "go": 20000, "rust": 20000, "cpp": 20000, "c": 20000, "csharp": 20000, "ruby": 20000,
    "php": 20000, "swift": 20000, "kotlin": 10000, "scala": 10000, "shell": 10000,
    "haskell": 5000, "elixir": 5000, "erlang": 2000, "clojure": 5000, "ocaml": 2000,
    "fsharp": 2000, "r": 5000, "julia": 5000, "lua": 5000, "perl": 2000,
    "elm": 1000, "purescript": 500, "nim": 1000, "crystal": 1000, "zig": 2000, "d": 500,
    "ada": 500, "fortran": 500, "racket": 500, "scheme": 500, "commonlisp": 500,
    "gleam": 200, "roc": 100, "unison": 100, "koka": 100, "vale": 100, "odin": 200,
    "pony": 200, "idris": 200, "agda": 200, "coq": 500, "lean": 500,
}
# Language tiers in query order, with their star floors.
MAINSTREAM = ("python", "javascript", "typescript", "java", "go", "rust", "cpp", "c", "ruby", "php",
              "csharp", "swift", "kotlin", "scala", "shell")
NICHE = ("haskell", "ocaml", "fsharp", "elixir", "erlang", "clojure", "elm", "purescript",
         "commonlisp", "scheme", "racket", "agda", "idris", "coq", "lean", "r", "julia", "matlab",
         "nim", "d", "ada", "fortran", "assembly", "prolog", "lua", "perl", "tcl", "forth",
         "smalltalk", "crystal", "v")
EMERGING = ("zig", "gleam", "mojo", "pony", "roc", "unison", "koka", "vale", "odin", "carbon", "bun")
MAINSTREAM_FLOOR, NICHE_FLOOR, EMERGING_FLOOR = 50, 20, 10
# ---------------------------------------------------------------------------

BAND_KEY = ("tier", "language", "star_range_low")


def tier_table(spark: SparkSession, min_stars: int = 50, include_niche: bool = True,
               include_emerging: bool = True, languages: list[str] | None = None) -> DataFrame:
    """BND1: ``(tier, tier_ord, language, lang_ord, floor, start)``.

    With ``languages`` the census is the single ``custom`` tier at
    ``min_stars``; otherwise mainstream uses ``max(min_stars, 50)``.
    """
    rows = []
    if languages:
        tiers = [("custom", list(languages), min_stars)]
    else:
        tiers = [("mainstream", MAINSTREAM, max(min_stars, MAINSTREAM_FLOOR))]
        if include_niche:
            tiers.append(("niche", NICHE, NICHE_FLOOR))
        if include_emerging:
            tiers.append(("emerging", EMERGING, EMERGING_FLOOR))
    for t_ord, (tier, langs, floor) in enumerate(tiers):
        for l_ord, lang in enumerate(langs):
            rows.append((tier, t_ord, lang.lower(), l_ord, floor,
                         START_THRESHOLDS.get(lang.lower(), DEFAULT_START)))
    return spark.createDataFrame(
        rows, "tier string, tier_ord int, language string, lang_ord int, floor int, start int")


def ladder(tiers: DataFrame, cut_points=CUT_POINTS) -> DataFrame:
    """BND2: one row per band; ``high`` is NULL for the unbounded top band.

    Cut points in ``[floor, start]`` high to low, the floor appended when it
    is not a cut point; band i ends at ``low(i-1) - 1``.
    """
    cuts = F.array(*[F.lit(c) for c in sorted(cut_points, reverse=True)])
    kept = F.filter(cuts, lambda c: (c >= F.col("floor")) & (c <= F.col("start")))
    lows = F.when(F.array_contains(kept, F.col("floor")), kept).otherwise(
        F.concat(kept, F.array(F.col("floor"))))
    bands = F.transform(lows, lambda low, i: F.struct(
        (i + 1).alias("band_ord"), low.alias("low"),
        F.when(i == 0, F.lit(None).cast("int")).otherwise(lows[i - 1] - 1).alias("high")))
    return (tiers.select("tier", "tier_ord", "language", "lang_ord", "floor",
                         F.explode(bands).alias("b"))
            .select("tier", "tier_ord", "language", "lang_ord", "floor",
                    F.col("b.band_ord").alias("band_ord"),
                    F.col("b.low").alias("star_range_low"), F.col("b.high").alias("star_range_high")))


def in_band(stars: Column, low: Column, high: Column) -> Column:
    return (stars >= low) & (high.isNull() | (stars <= high))


def band_matches(snapshot: DataFrame, bands: DataFrame, exclude_forks: bool = True,
                 by_language: bool = True) -> DataFrame:
    """BND4: rows of the snapshot in each band (broadcast range join)."""
    snap = snapshot
    if exclude_forks:
        snap = snap.filter(~F.coalesce(F.col("fork"), F.lit(False)))
    snap = snap.select("full_name", "stars", F.lower("language").alias("_lang"))
    b = F.broadcast(bands.alias("b"))
    cond = in_band(F.col("stars"), F.col("b.star_range_low"), F.col("b.star_range_high"))
    if by_language:
        cond = (F.col("_lang") == F.col("b.language")) & cond
    return snap.join(b, cond, "inner").drop("_lang")


def band_low(stars: Column, lows: list[int]) -> Column:
    """Band of a star count for one fixed ladder (lows high to low): a CASE
    expression, no join needed; NULL below the floor."""
    expr = None
    for low in sorted(lows, reverse=True):
        expr = F.when(stars >= low, F.lit(low)) if expr is None else expr.when(stars >= low, F.lit(low))
    return expr


def cap_per_band(matches: DataFrame, cap: int, keys=BAND_KEY) -> DataFrame:
    """BND5 rows: the ``cap`` highest-starred rows of each band with their
    ``rank`` (ties by name).  Ranks are numbered over ranges of rows, so a band
    that holds most of the table is spread over many tasks whatever the cap."""
    ranked = seq_number(matches, list(keys), [F.col("stars").desc(), F.col("full_name")], name="rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).filter(F.col("rank") <= cap)


def band_totals(matches: DataFrame, keys=BAND_KEY) -> DataFrame:
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def census(snapshot: DataFrame, catalog: DataFrame, tiers: DataFrame, progress: DataFrame | None = None,
           cap: int | None = None, target: int | None = None, resume: bool = True,
           exclude_forks: bool = True, early_stop: bool = False) -> tuple[DataFrame, DataFrame]:
    """BND11: the whole tiered census.  Returns ``(summary, selected)``.

    A metadata snapshot is complete, so by default every eligible row of every
    band is returned.  ``cap`` (rows for each band), ``target`` (stop after so
    many new rows) and ``early_stop`` (leave a language at its first empty band)
    restate the limits of a remote search and are off unless asked for.

    ``selected`` has a ``rank`` where a cap is given.  ``summary`` has one row per ladder band with ``completed`` (skipped by
    resume), ``ran``, ``total``, ``returned``, ``truncated`` and ``new``
    (returned names not yet in ``catalog``); ``selected`` holds the returned
    rows of the bands that ran.
    """
    bands = ladder(tiers)
    if progress is not None and resume:
        done = (progress.select(*BAND_KEY).join(F.broadcast(bands.select(*BAND_KEY)), list(BAND_KEY), "left_semi")
                .distinct().withColumn("completed", F.lit(True)))
        bands = bands.join(F.broadcast(done), list(BAND_KEY), "left")  # no more rows than the ladder
        # a language whose floor band is complete is skipped as a whole
        floor_done = (bands.filter(F.col("completed") & (F.col("star_range_low") == F.col("floor")))
                      .select("tier", "language", F.lit(True).alias("lang_done")).distinct())
        bands = (bands.join(floor_done, ["tier", "language"], "left")
                 .withColumn("completed", F.coalesce("completed", "lang_done", F.lit(False)))
                 .drop("lang_done"))
    else:
        bands = bands.withColumn("completed", F.lit(False))

    matches = band_matches(snapshot, bands.filter(~F.col("completed")), exclude_forks)
    totals = band_totals(matches)
    top = matches if cap is None else cap_per_band(matches, cap)
    known = catalog.select("full_name").distinct()
    news = (top.join(known, "full_name", "left_anti").select(*BAND_KEY, "full_name").distinct()
            .groupBy(*BAND_KEY).agg(F.count(F.lit(1)).alias("new")))

    s = (bands.join(totals, list(BAND_KEY), "left").join(news, list(BAND_KEY), "left")
         .withColumn("total", F.coalesce("total", F.lit(0)).cast("bigint"))
         .withColumn("new", F.coalesce("new", F.lit(0)).cast("bigint")))
    s = s.withColumn("candidate", ~F.col("completed"))
    if early_stop:  # BND6: nothing after the first empty band of a language that ran
        lang_w = (Window.partitionBy("tier", "language").orderBy("band_ord")
                  .rowsBetween(Window.unboundedPreceding, -1))
        empty_before = F.max(F.when(~F.col("completed") & (F.col("total") == 0), 1).otherwise(0)).over(lang_w)
        s = s.withColumn("candidate", F.col("candidate") & (F.coalesce(empty_before, F.lit(0)) == 0))
    # BND7: run while the new rows stored so far stay under the target.
    if target:
        glob_w = (Window.orderBy("tier_ord", "lang_ord", "band_ord")
                  .rowsBetween(Window.unboundedPreceding, -1))
        before = F.coalesce(F.sum(F.when(F.col("candidate"), F.col("new")).otherwise(0)).over(glob_w), F.lit(0))
        s = s.withColumn("ran", F.col("candidate") & (before < target))
    else:
        s = s.withColumn("ran", F.col("candidate"))
    s = s.withColumn("total", F.when(F.col("ran"), F.col("total")).otherwise(F.lit(0).cast("bigint"))) \
         .withColumn("new", F.when(F.col("ran"), F.col("new")).otherwise(F.lit(0).cast("bigint"))) \
         .withColumn("returned", F.least(F.col("total"), F.lit(cap).cast("bigint"))) \
         .withColumn("truncated", F.coalesce(F.col("total") > F.lit(cap).cast("bigint"), F.lit(False))) \
         .drop("candidate")
    summary = s.select("tier", "tier_ord", "language", "lang_ord", "band_ord", "star_range_low",
                       "star_range_high", "completed", "ran", "total", "returned", "truncated", "new")
    ran = summary.filter("ran").select(*BAND_KEY)
    ranks = [] if cap is None else ["rank"]
    selected = top.join(F.broadcast(ran), list(BAND_KEY), "left_semi").select(  # one row per ladder band at most
        *BAND_KEY, "full_name", "stars", *ranks)
    return summary, selected


def mark_complete(progress: DataFrame | None, summary: DataFrame) -> DataFrame:
    """BND8: keyed replace of the progress rows of the bands that ran."""
    new = summary.filter("ran").select(
        "tier", "language", "star_range_low", "star_range_high",
        F.col("returned").alias("repos_found"))
    if progress is None:
        return new
    return progress.join(new.select(*BAND_KEY), list(BAND_KEY), "left_anti").unionByName(new)


def pending_bands(bands: DataFrame, progress: DataFrame) -> DataFrame:
    """BND9: ladder bands not yet recorded as complete."""
    return bands.join(progress.select(*BAND_KEY), list(BAND_KEY), "left_anti")


def clear_progress(progress: DataFrame, tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """BND10: drop all progress (``tier`` None) or one tier's; an empty
    string matches no tier.  Returns ``(remaining, counts)`` where counts has
    ``removed`` and ``remaining``."""
    hit = F.lit(True) if tier is None else (F.col("tier") == F.lit(tier))
    remaining = progress.filter(~hit)
    counts = progress.agg(F.count_if(hit).alias("removed"), F.count_if(~hit).alias("remaining"))
    return remaining, counts


def tier_progress(progress: DataFrame) -> DataFrame:
    """RPT6: completed queries and rows found per tier plus a grand total
    (``tier`` NULL) in one ROLLUP."""
    return (progress.rollup("tier")
            .agg(F.count(F.lit(1)).alias("queries_complete"),
                 F.coalesce(F.sum("repos_found"), F.lit(0)).cast("bigint").alias("repos_found")))


def global_census(snapshot: DataFrame, min_stars: int = 100, target: int | None = None,
                  cap: int | None = None, exclude_forks: bool = True) -> DataFrame:
    """BND3: census without a language.  By default every eligible row.  With
    ``cap`` a broad query returns the ``cap`` highest-starred rows, and so does
    every band of the ladder (union, first seen); with ``target`` bands run while
    fewer rows are collected, and the ``target`` highest-starred rows stay."""
    snap = snapshot
    if exclude_forks:
        snap = snap.filter(~F.coalesce(F.col("fork"), F.lit(False)))
    snap = snap.filter(F.col("stars") >= min_stars).select("full_name", "stars")
    best = [F.col("stars").desc(), F.col("full_name")]
    union = snap
    if cap is not None:
        lows = [c for c in CUT_POINTS if c >= min_stars]
        if not lows or lows[-1] > min_stars:
            lows.append(min_stars)
        broad = snap.orderBy(*best).limit(cap)
        banded = snap.withColumn("star_range_low", band_low(F.col("stars"), lows))
        extra = (cap_per_band(banded, cap, keys=("star_range_low",)).drop("rank")
                 .join(broad.select("full_name"), "full_name", "left_anti"))
        if target is not None:
            n_broad = broad.count()  # at most ``cap``
            per_band = extra.groupBy("star_range_low").agg(F.count(F.lit(1)).alias("new"))
            bw = Window.orderBy(F.col("star_range_low").desc()).rowsBetween(Window.unboundedPreceding, -1)
            ran = (per_band.withColumn("before", F.lit(n_broad) + F.coalesce(F.sum("new").over(bw), F.lit(0)))
                   .filter(F.col("before") < target).select("star_range_low"))  # at most one row per cut point
            extra = extra.join(F.broadcast(ran), "star_range_low", "left_semi")
        union = broad.unionByName(extra.select("full_name", "stars"))
    if target is None:
        return union
    ranked = seq_number(union.withColumn("_all", F.lit(0)), ["_all"], best, name="_rank")
    return ranked.filter(F.col("_rank") <= target).drop("_all", "_rank")


def refresh(snapshot: DataFrame, catalog: DataFrame, tiers: DataFrame, progress: DataFrame | None,
            cap: int | None = None, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """BND11 refresh mode: clear all progress, re-run the whole census
    without resume and upsert the returned rows into the catalog (new names
    pending, known names get fresh metadata).  Returns ``(catalog, progress)``."""
    from corpusflow.operators.catalog import upsert

    cleared = None if progress is None else clear_progress(progress)[0]
    summary, selected = census(snapshot, catalog, tiers, progress=cleared, cap=cap, target=target, resume=False)
    meta = [c for c in ("stars", "language", "license_key", "size_kb", "default_branch", "fork", "archived",
                        "updated_at") if c in snapshot.columns]
    batch = (selected.select("full_name").distinct().join(snapshot.select("full_name", *meta), "full_name")
             .withColumn("arrival", F.lit(1)))
    return upsert(catalog, batch), mark_complete(cleared, summary)
