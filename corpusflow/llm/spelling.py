"""Spelling variants by PartEnum signatures.

A word is the multiset of its code points, a binary vector with one dimension for each
copy of each letter.  One inserted or deleted code point moves one dimension, a
replaced one moves two, so near words have vectors at Hamming distance two at
most.  The letters are dealt to ``PARTS`` parts; two vectors at distance two agree on
all but two parts, so they agree on one choice of ``PARTS - 2`` parts.  A signature is
a choice of parts with the word's letters in them, sorted; words that share a
signature are joined and verified as edit distance one.  All of it is DataFrame
functions: a signature is the sorted word with the other parts' letters deleted.

Buckets of one signature with more than ``BUCKET`` words (anagrams of few letters) are not
paired as such: inside them words are joined on equal words after deleting at most one
code point, which near words always have in common, so nothing is lost and no
bucket is compared in full.

A word's form is its most frequent near word if that is ``RATIO`` times as frequent;
roots follow forms by pointer doubling (counts grow along forms, so there are no
cycles).

Defined cases: null and empty texts have no words; a null ``doc_id`` counts as an empty
string in the digest; repeated rows count as often as they occur; an empty table
gives no rows; other columns are ignored.  Order is code-point order throughout.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import keep

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
PARTS = 5
BUCKET = 256
RUN = r"[A-Za-zÀ-ÿ]"
#: letters from frequent to rare, so that dealing them in turn balances the parts
LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, word``: every maximal run of at least ``min_length`` letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase),
                                F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    return docs.select("doc_id", "text").select("doc_id", F.explode(runs).alias("word"))


def misspelt(words: DataFrame) -> DataFrame:
    """Test noise: where 31 divides the digest of ``<doc_id>:<word>``, one code point is deleted."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word").cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substr(F.col("word"), F.lit(1), at), F.substr(F.col("word"), at + 2))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def signatures(word: Column, parts: int = PARTS) -> Column:
    """``array<bigint>``: digests of the signatures for distance two."""
    dealt = ["" for _ in range(parts)]
    for i, c in enumerate(LETTERS):
        turn, place = divmod(i, parts)
        dealt[place if turn % 2 == 0 else parts - 1 - place] += c
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    return F.array(*[F.xxhash64(F.lit(i), F.translate(letters, "".join(dealt[a] + dealt[b]), ""))
                     for i, (a, b) in enumerate(itertools.combinations(range(parts), 2))])


def _with_deletions(word: Column) -> Column:
    """The word and every word with one code point less."""
    return F.array_distinct(F.array_append(F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))), word))


def _verified(x: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows equal in ``on`` whose words differ by one edit."""
    a, b = x.alias("a"), x.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    one = (F.col("a.word") < F.col("b.word")) & (F.abs(F.col("a.size") - F.col("b.size")) <= 1) & (
        F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return a.join(b, same & one).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))


def near_pairs(words: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """``a, b`` (``a < b``): all pairs of different words at edit distance one, once each."""
    rows = words.select("word", F.length("word").alias("size"), F.explode(signatures(F.col("word"), parts)).alias("sig"))
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rows = keep(rows.join(shared, "sig"), "spelling-buckets")
    small = _verified(rows.where(F.col("held") <= bucket).select("sig", "word", "size"), ["sig"])
    crowded = rows.where(F.col("held") > bucket).select("sig", "word", "size", F.explode(_with_deletions(F.col("word"))).alias("less"))
    return small.union(_verified(crowded.select("sig", F.xxhash64("less").alias("less"), "word", "size"), ["sig", "less"])).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: forms followed to the last, by doubling."""
    at = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return at


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (``word, n``, words distinct)."""
    words = keep(words.select("word", "n"), "spelling-words")
    pairs = keep(near_pairs(words), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a"))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = (both.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b"))).alias("top"))
            .select(F.col("a").alias("word"), "n_near", F.col("top.b").alias("b"), (-F.col("top.m")).alias("m")))
    taken = F.col("m") >= ratio * F.col("n")
    named = keep(words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("m")).alias("form_n")), "spelling-forms")
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
