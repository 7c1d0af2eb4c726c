"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms and accents are taken off, look-alike
letters of other scripts and digit or sign substitutions inside words become
Latin letters, runs of three or more equal letters become one, case is dropped,
and words are joined by single blanks.  Lexicon entries are whole words or
word beginnings (4 to 8 letters); one automaton finds all of them in one pass
over the whole folded text.  A match inside an exception phrase (two words)
does not count.  A document's evidence is the sum of the weights of its
distinct matched words, set against its number of distinct words, and a
logistic curve over both gives the score.

Everything is learned here from labelled rows that the caller allows, at most
``TRAIN_ROWS`` of them (those with the smallest digests of their id):

* the lexicon: per entry, in how many (document, distinct word) pairs it occurs
  in toxic and other texts, as smoothed log odds; entries need ``MIN_SUPPORT``
  pairs and a z-score of ``MIN_Z``; at most ``MAX_ENTRIES`` are kept.  Counting is
  a Spark aggregation over words, combined inside tasks first;
* exception phrases: pairs of words with a lexicon word that other texts use
  and toxic ones hardly do;
* the curve: a logistic fit over the evidence of the training rows.

Defined cases: null and empty texts have no evidence and get the score of none; training rows
without a word or without a match add nothing to the lexicon or the exceptions;
labels that are null or disagree count as toxic if any is 1; without toxic or
without other training rows every score is the share of toxic rows; repeated
rows are scored one by one; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 50_000
MAX_ENTRIES = 2_000
MAX_EXCEPTIONS = 2_000
MIN_SUPPORT = 12
MIN_Z = 4.0
PREFIX = (4, 8)

# fixed values: letters that look like Latin ones (Cyrillic, Greek)
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнпгиαεορτυνικβχ", "aeopcyxijsdhlkmtbhnruaeoptuvikbx"))
# fixed values: digits and signs that stand for letters inside words
SUBSTITUTES = dict(zip("013457@$", "oieast" + "as"))
_TABLE = str.maketrans(LOOKALIKES)
_SUBS = str.maketrans(SUBSTITUTES)
_MARKS = re.compile("[̀-ͯ]+")
_TOKEN = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*|[@$][^\W\d_]+(?:[@$]*[^\W_]+)*")
_LEET = re.compile(r"[013457@$]")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1{2,}")


def fold(text: str | None) -> list[str]:
    """The folded words of a text, in order."""
    if not text:
        return []
    low = unicodedata.normalize("NFKD", text).lower() if not text.isascii() else text.lower()
    if not low.isascii():
        low = _MARKS.sub("", low).translate(_TABLE)
    found = _TOKEN.findall(low)
    if _LEET.search(low):
        found = [w.translate(_SUBS) if _LEET.search(w) and _LETTER.search(w) else w for w in found]
    if _RUN.search(low):
        found = [_RUN.sub(r"\1", w) for w in found]
    return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)  # "word word"
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            found.add_word(f" {p} ", (len(p) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def matched(found, tokens: list[str]) -> dict[str, float]:
    """Distinct matched words with their greatest weight."""
    if not tokens or not len(found):
        return {}
    line = f" {' '.join(tokens)} "
    hits, shields = [], []
    for end, (size, weight) in found.iter(line):
        start = end - size + 1
        (hits if weight is not None else shields).append((start, end, weight))
    out: dict[str, float] = {}
    for start, end, weight in hits:
        if not any(a <= start and end <= b for a, b, _ in shields):
            word = line[start + 1:line.index(" ", start + 1)]
            out[word] = max(out.get(word, 0.0), weight)
    return out


def evidence(found, text: str | None) -> tuple[float, float]:
    """Summed weight of the distinct matched words, and the same per distinct word."""
    tokens = fold(text)
    total = sum(matched(found, tokens).values())
    return total, total / (len(set(tokens)) or 1)


def _features(total: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.sqrt(density), density], 1)


def _score(curve: tuple[float, ...], total: np.ndarray, density: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(total, density) @ np.array(curve), -30, 30)))


def _counted(column: str, by: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
    """The counts of both classes as one frame; nothing where nothing was counted
    (a frame of empty lists has no string column)."""
    keys = list(by[0].keys() | by[1].keys())
    if keys:
        yield pd.DataFrame({column: keys, "neg": [by[0][k] for k in keys], "pos": [by[1][k] for k in keys]})


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``text, y`` of the labelled documents, at most ``TRAIN_ROWS`` label rows."""
    y = labels.groupBy("doc_id").agg(F.max(label).alias("y")).where("y is not null and doc_id is not null")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y")  # bounded by TRAIN_ROWS


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    rows = training_rows(docs, labels, label)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by = (Counter(), Counter())
            for text, y in zip(b["text"], b["y"]):
                by[int(y > 0)].update(set(fold(text)))
            yield from _counted("word", by)

    counts = (rows.mapInPandas(count, "word string, neg bigint, pos bigint")
              .groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    low, high = PREFIX
    entries = F.concat(
        F.array(F.concat(F.lit(" "), "word", F.lit(" "))),
        F.when(F.length("word") > low, F.transform(
            F.sequence(F.lit(low), F.least(F.lit(high), F.length("word") - 1)),
            lambda k: F.concat(F.lit(" "), F.substr(F.col("word"), F.lit(1), k)))).otherwise(F.array().cast("array<string>")))
    totals = counts.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).first()
    if not totals["neg"] or not totals["pos"]:
        share = rows.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Lexicon(curve=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    by_entry = (counts.select(F.explode(entries).alias("entry"), "neg", "pos")
                .groupBy("entry").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
                .where(F.col("pos") >= MIN_SUPPORT))
    # log odds with one pseudo count shared by the classes' sizes, and their z-score
    n, p = float(totals["neg"]), float(totals["pos"])
    a, b = 2 * n / (n + p), 2 * p / (n + p)
    odds = F.log((F.col("pos") + b) / p) - F.log((F.col("neg") + a) / n)
    z = odds / F.sqrt(1 / (F.col("pos") + b) + 1 / (F.col("neg") + a))
    best = (by_entry.withColumns({"weight": odds, "z": z}).where((F.col("z") >= MIN_Z) & (F.col("weight") >= 1.0))
            .orderBy(F.desc("z"), "entry").limit(MAX_ENTRIES).collect())
    lexicon = Lexicon({r["entry"]: float(r["weight"]) for r in best})

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lexicon.automaton()
        for batch in batches:
            by = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["y"]):
                tokens = fold(text)
                if hit := matched(found, tokens):
                    by[int(y > 0)].update({f"{u} {v}" for u, v in zip(tokens, tokens[1:]) if u in hit or v in hit})
            yield from _counted("pair", by)

    spared = (rows.mapInPandas(phrases, "pair string, neg bigint, pos bigint")
              .groupBy("pair").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
              .where((F.col("neg") >= MIN_SUPPORT) & (F.col("pos") * 20 <= F.col("neg")))
              .orderBy(F.desc("neg"), "pair").limit(MAX_EXCEPTIONS).collect())
    lexicon.exceptions = [r["pair"] for r in spared]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lexicon.automaton()
        for batch in batches:
            got = [evidence(found, t) for t in batch["text"]]
            yield pd.DataFrame({"total": [x[0] for x in got], "density": [x[1] for x in got], "y": batch["y"] > 0})

    points = rows.mapInPandas(measure, "total double, density double, y boolean")
    # equal points are summed, so the driver gets at most TRAIN_ROWS short rows
    points = points.groupBy("total", "density").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("int")).alias("pos")).toPandas()
    points = points.sort_values(["total", "density"])
    lexicon.curve = fit(*(points[c].to_numpy(float) for c in ("total", "density", "n", "pos")))
    return lexicon


def fit(total: np.ndarray, density: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = _features(total, density)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (pos - n * mu) - 0.1 * beta
        hess = (x * (n * mu * (1 - mu))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, evidence, density`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lexicon.automaton()
        for b in batches:
            got = np.array([evidence(found, t) for t in b["text"]], float).reshape(-1, 2)
            yield pd.DataFrame({"key": b["key"], "score": _score(lexicon.curve, got[:, 0], got[:, 1]),
                                "evidence": got[:, 0], "density": got[:, 1]})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    return rows.mapInPandas(run, "key string, score double, evidence double, density double").select(
        F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score", "evidence", "density")
