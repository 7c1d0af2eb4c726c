"""Quality rules: a threshold table compiled into one projection.

Every rule bounds one ratio of a document; :func:`compile_rules` turns the
table into a single boolean expression over the metric columns, so that the
whole filter is one map-only projection of built-in functions (no shuffle, no
user function).

Defined cases: a null or empty text has no words, all its counts are 0 and it
fails the base rule; repeated rows are judged one by one; columns of the input
with the names of metrics are kept out of the way (metrics are computed from
``text`` alone and replace them); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"
# fixed values: frequent function words of the four languages of the corpus
STOP_WORDS = (
    "the of and to in that is with for as it was on by or are at be this have from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un une du que est pour qui dans par sur pas plus "
    "el los las se del por con su para al lo como más o pero"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a bound that is None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("mark_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("bar_line_ratio", None, 0.5),
)


def repeat_words(n_words: Column, word_hashes: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their word hashes within one
    document.  Texts without a repeated window (seen from the distinct count)
    skip the sort.
    """
    k = REPEAT_WINDOW
    no_windows = F.array().cast("array<bigint>")
    grams = F.transform(
        F.array(word_hashes),
        lambda h: F.when(n_words >= k, F.transform(
            F.sequence(F.lit(0), n_words - k),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(no_windows))

    def covered(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        starts = F.flatten(F.transform(F.array(by_hash), repeated))
        walked = F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + k - F.greatest(F.lit(0), a["end"] - p)).alias("n"),
                                  (p + k).alias("end")))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), walked["n"]).otherwise(F.lit(0))

    return F.get(F.transform(grams, covered), F.lit(0)).cast("bigint")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression that holds if every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= F.lit(float(r.high)))
    return ok


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words",
           "n_lines", "n_bar_lines", "base_failed", "kept", *(r.metric for r in RULES))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, ratios, ``base_failed`` and ``kept``."""
    clash = [c for c in docs.columns if c in METRICS]
    text = F.coalesce(F.col("text"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = (
        docs.drop(*clash)
        .withColumns({"_words": words(F.col("text")), "_lines": with_word})
        .withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
                      "n_words": F.size("_words").cast("bigint")})
        .withColumns({
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
            "n_marks": F.regexp_count(text, F.lit(MARKS)).cast("bigint"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_bar_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("|"))).cast("bigint"),
            "n_repeat_words": repeat_words(F.size("_words"), F.col("_hashes")),
        })
        .withColumns({
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "mark_ratio": _ratio(F.col("n_marks"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "bar_line_ratio": _ratio(F.col("n_bar_lines"), F.col("n_lines")),
        })
    )
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop("_words", "_lines", "_hashes")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))
    return measure(kept, rules).where("kept").select("_doc.*")
