"""Distributed, deterministic question-answer corpora (GEN1-GEN14).

Every generated value is a pure function of ``(seed, example_id, slot)``
(:mod:`corpusflow.functions.hashrand`), so the same rows come out for any
partitioning, executor count or task retry.  An example is built in one
projection: chunk and sentence arrays come from ``transform`` over
``sequence`` ranges, so generation is a map-only job with no shuffle.
The templates and word lists below are this project's own; the fixed
values shared with the reference are the category names and the three
key-value render formats.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashrand import X, arr, col, lit, pick, rint, var

# --- fixed values ----------------------------------------------------------
# Category names; the category code is the position in this list.
CATEGORY_NAMES = ("simple", "entity", "code", "lookup", "temporal", "numeric", "definition", "assertion")
# Key-value render formats of lookup entries.
KV_FORMATS = ("{key} -> {value}.", "{key}: {value}.", "{key} = {value}.")
# Share of haystack sentences replaced by hard negatives.
HARD_NEGATIVE_RATE = 0.2
# ---------------------------------------------------------------------------

ADJECTIVES = ("amber", "brisk", "calm", "dusty", "eager", "faint", "gentle", "hollow", "icy", "jolly",
              "keen", "lofty", "muddy", "narrow", "odd", "pale", "quaint", "rustic", "sturdy", "tidy",
              "vivid", "weary")
NOUNS = ("anchor", "basket", "candle", "drum", "engine", "feather", "garden", "harbor", "island", "jacket",
         "kettle", "ladder", "mirror", "needle", "orchard", "pebble", "quarry", "river", "saddle", "tower",
         "valley", "wagon")
VERBS = ("admired", "borrowed", "carried", "dropped", "followed", "guarded", "painted", "polished",
         "repaired", "shaped", "traded", "watched")
PLACES = ("old mill", "market square", "north field", "harbor town", "mountain pass", "quiet library",
          "river bend", "stone bridge", "village hall", "forest edge", "train depot", "salt marsh")
FILLER_TEMPLATES = (
    "Whoever {did} that {how} {what} also cared for a {other} {near}.",
    "Past the {where} one could make out a {what}, rather {how}.",
    "Nobody expected such a {how} {what} here.",
    "Between {what} and {near} lay something {how}.",
    "Letters from {when} mention a {how} {what} by the {where}.",
    "Travelers {did} their {what} on the road to the {where}.",
    "Each {how} {what} rested next to a {other} {near}.",
    "People at the {where} were proud of one {how} {what}.",
    "Someone {did} a {what} and left it {how}.",
    "Not before {when} did anyone call a {near} {other} or {how}.",
)
# slots of the filler templates, in the order of their draws; {when} is a year
FILLER_SLOTS = (("how", ADJECTIVES), ("other", ADJECTIVES), ("what", NOUNS), ("near", NOUNS), ("did", VERBS), ("where", PLACES))
# (category, statement, question, answer, kind of {a}, kind of {b})
NEEDLE_TEMPLATES = (
    ("simple", "The locker in the hall opens with {a}.", "What opens the locker in the hall?", "{a}", "badge", None),
    ("simple", "Tonight the guards expect the signal {a}.", "Which signal do the guards expect tonight?", "{a}", "badge", None),
    ("simple", "The parrot on the stairs only answers to {a}.", "To what does the parrot on the stairs answer?", "{a}",
     "word", None),
    ("entity", "{a} keeps a bakery in {b}.", "Where does {a} keep a bakery?", "{b}", "person", "town"),
    ("entity", "The ferry {a} is steered by {b}.", "Who steers the ferry {a}?", "{b}", "ship", "person"),
    ("entity", "Through {a} runs the river {b}.", "Which river runs through {a}?", "{b}", "town", "river"),
    ("entity", "{a} learned the violin from {b}.", "From whom did {a} learn the violin?", "{b}", "person", "person"),
    ("code", "Queue {a} retries every job {b} times.", "How often does queue {a} retry a job?", "{b}", "ident", "number"),
    ("code", "Service {a} appends its log to {b}.", "Where does service {a} append its log?", "{b}", "ident", "path"),
    ("code", "Node {a} answers on port {b}.", "On which port does node {a} answer?", "{b}", "host", "port"),
    ("code", "Table {a} is partitioned by {b}.", "By which column is table {a} partitioned?", "{b}", "ident", "ident"),
    ("code", "Job {a} waits until job {b} is done.", "For which job does job {a} wait?", "{b}", "ident", "ident"),
    ("code", "Build {a} pins the parser at {b}.", "At what does build {a} pin the parser?", "{b}", "badge", "version"),
    ("temporal", "The lighthouse of {a} went dark on {b}.", "When did the lighthouse of {a} go dark?", "{b}", "town", "day"),
    ("temporal", "{a} rings the bell at {b}.", "At what time does {a} ring the bell?", "{b}", "person", "clock"),
    ("temporal", "The ferry {a} was launched in {b}.", "In which year was the ferry {a} launched?", "{b}", "ship", "year"),
    ("numeric", "The stairs to the tower of {a} have {b} steps.", "How many steps lead to the tower of {a}?", "{b}",
     "town", "number"),
    ("numeric", "{a} pulled a pike of {b} out of the pond.", "How heavy was the pike of {a}?", "{b}", "person", "measure"),
    ("numeric", "On the ferry {a} there is room for {b} barrels.", "For how many barrels is there room on the ferry {a}?",
     "{b}", "ship", "number"),
    ("definition", "Among weavers {a} means a {b} thread.", "What colour is a thread that weavers call {a}?", "{b}",
     "word", "colour"),
    ("definition", "Old maps call the river {b} by the name {a}.", "Which river do old maps call {a}?", "{b}", "word", "river"),
    ("definition", "A {a} is what fishers call a {b}.", "What do fishers mean by a {a}?", "{b}", "word", "craft"),
    ("assertion", "Does {a} own a boat? {b}, by all accounts.", "Does {a} own a boat?", "{b}", "person", "yesno"),
    ("assertion", "Is there a theatre in {a}? {b}, says the guide.", "Is there a theatre in {a}?", "{b}", "town", "yesno"),
)
SLOT_KINDS = ("badge", "word", "person", "town", "ship", "river", "firm", "ident", "host", "path", "number", "port", "day",
              "year", "clock", "measure", "version", "craft", "colour", "yesno")
COLOURS = ("red", "ochre", "teal", "violet", "white", "green", "grey", "rose")
CRAFTS = ("net", "hook", "oar", "lantern", "rope", "basket", "anchor", "sail")

# Syllables by rule: consonant x vowel.
SYLLABLES = tuple(c + v for c in "bdfgklmnprstvz" for v in "aeiou")
TOKEN_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


# --- GEN1: typed values (SQL text, see functions.hashrand) -------------------
# A value is read off a digest: eight 16-bit draws, of which it uses three.

def digest(*parts) -> X:
    inner = ", ".join(f"cast({p} as string)" if isinstance(p, X) else lit(str(p)) for p in parts)
    return X(f"md5(concat_ws(':', {inner}))")


def _draw(digest: X, i: int, n: int) -> X:
    """Draw ``i`` (0..7) of a hex digest as an integer in ``[0, n)``."""
    return X(f"pmod(cast(conv(substring({digest}, {4 * i + 1}, 4), 16, 10) as int), {n})")


def _pick(options, d: X, i: int) -> X:
    return X(f"element_at({arr(options)}, {_draw(d, i, len(options))} + 1)")


def _chars(options, length: X, *key) -> X:
    j = var()
    return X(f"array_join(transform(sequence(1, cast({length} as int)), {j} -> "
             f"element_at({arr(options)}, cast({rint(len(options), *key, j)} + 1 as int))), '')")


def slot_value(kind: str, d: X, at: int) -> X:
    """A value of ``kind`` from the draws ``at .. at + 2`` of digest ``d``."""
    one, two, three = (_pick(SYLLABLES, d, at + i) for i in range(3))
    plain = X(f"concat({one}, {two}, {three})")
    if kind == "badge":
        return X(f"upper(concat(substring({d}, {4 * at + 1}, 4), '-', substring({d}, {4 * at + 5}, 6)))")
    if kind == "word":
        return plain
    if kind == "person":
        return X(f"concat(initcap(concat({one}, {two})), ' ', initcap(concat({three}, {two}, 'n')))")
    if kind == "town":
        return X(f"concat(initcap({plain}), 'by')")
    if kind == "ship":
        return X(f"concat('Lady ', initcap({plain}))")
    if kind == "river":
        return X(f"initcap(concat({plain}, 'l'))")
    if kind == "firm":
        return X(f"concat(initcap(concat({one}, {two})), ' & ', initcap(concat({three}, {one})))")
    if kind == "ident":
        return X(f"concat({one}, {two}, '_', {three}, cast({_draw(d, at, 97)} as string))")
    if kind == "host":
        return X(f"concat({one}, {two}, '-', lpad(cast({_draw(d, at + 2, 1000)} as string), 3, '0'))")
    if kind == "path":
        return X(f"concat('/var/', {one}, {two}, '/', {three}, '-', cast({_draw(d, at, 1000)} as string), '.log')")
    if kind == "number":
        return X(f"cast(2 + {_draw(d, at, 50000)} as string)")
    if kind == "port":
        return X(f"cast(1024 + {_draw(d, at, 64000)} as string)")
    if kind == "day":
        return X(f"date_format(date_add(date'1950-01-01', {_draw(d, at, 30000)}), 'd MMMM yyyy')")
    if kind == "year":
        return X(f"cast(1700 + {_draw(d, at, 320)} as string)")
    if kind == "clock":
        return X(f"concat(lpad(cast({_draw(d, at, 24)} as string), 2, '0'), ':', lpad(cast({_draw(d, at + 1, 60)} as string), 2, '0'))")
    if kind == "measure":
        return X(f"concat(cast(1 + {_draw(d, at, 400)} as string), '.', cast({_draw(d, at + 1, 10)} as string), ' kg')")
    if kind == "version":
        return X(f"concat('r', cast({_draw(d, at, 400)} as string), '.', cast({_draw(d, at + 1, 100)} as string))")
    if kind == "craft":
        return X(f"concat({_pick(COLOURS, d, at + 1)}, ' ', {_pick(CRAFTS, d, at)})")
    if kind == "colour":
        return _pick(COLOURS, d, at)
    if kind == "yesno":
        return _pick(("Yes", "No"), d, at)
    raise ValueError(kind)


def _render(template: str, a: X, b: X | None) -> X:
    """Literal pieces and slot values of one template, concatenated."""
    parts = [p for p in re.split(r"(\{[ab]\})", template) if p]
    return X("concat(" + ", ".join({"{a}": a, "{b}": b}.get(p) or lit(p) for p in parts) + ")")


def _slots(t: tuple, d: X) -> tuple[X, X | None]:
    return slot_value(t[4], d, 1), slot_value(t[5], d, 4) if t[5] else None


# --- GEN2, GEN3, GEN4: sentences ---------------------------------------------------

def filler_sentence(*key) -> X:
    """GEN2: one filler sentence from the templates and word lists."""
    s = pick(FILLER_TEMPLATES, *key, "t")
    for tag, opts in FILLER_SLOTS:
        s = X(f"replace({s}, '{{{tag}}}', {pick(opts, *key, tag)})")
    return X(f"replace({s}, '{{when}}', cast(1900 + {rint(125, *key, 'when')} as string))")


def filler_from_digest(digest: X) -> X:
    """GEN2 from one precomputed md5 digest column: eight 16-bit draws pick
    the template, the six words and the year (one md5 per sentence)."""
    s = X(f"element_at({arr(FILLER_TEMPLATES)}, {_draw(digest, 0, len(FILLER_TEMPLATES))} + 1)")
    for i, (tag, opts) in enumerate(FILLER_SLOTS, start=1):
        s = X(f"replace({s}, '{{{tag}}}', element_at({arr(opts)}, {_draw(digest, i, len(opts))} + 1))")
    return X(f"replace({s}, '{{when}}', cast(1900 + {_draw(digest, 7, 125)} as string))")


def hard_negative(d: X) -> X:
    """GEN3: a needle statement with fresh values, all from one digest."""
    whens = " ".join(f"when {i} then {_render(t[1], *_slots(t, d))}" for i, t in enumerate(NEEDLE_TEMPLATES))
    return X(f"case {_draw(d, 0, len(NEEDLE_TEMPLATES))} {whens} end")


def is_hard(d: X) -> X:
    """GEN5: whether the sentence of digest ``d`` is a hard negative."""
    return X(f"({_draw(d, 7, 65536)} < {round(HARD_NEGATIVE_RATE * 65536)})")


def with_needle(df: DataFrame, seed, id_col: str = "example_id", salt: str = "needle") -> DataFrame:
    """GEN4 as columns: the two slot values of the example are computed once,
    and the statement, question and answer are rendered from them."""
    eid = X(id_col)
    t = rint(len(NEEDLE_TEMPLATES), seed, eid, salt, "t")
    df = df.select("*", col(X(f"cast({t} as int)")).alias("template_idx"), col(digest(seed, eid, salt, "v")).alias("_nd"))

    def by_template(of) -> X:
        whens = " ".join(f"when {i} then {of(t)}" for i, t in enumerate(NEEDLE_TEMPLATES))
        return X(f"case template_idx {whens} end")

    d = X("_nd")
    df = df.select("*", col(by_template(lambda t: _slots(t, d)[0])).alias("_va"),
                   col(by_template(lambda t: _slots(t, d)[1] or lit(""))).alias("_vb"))
    texts = [col(by_template(lambda t, f=f: _render(t[f], X("_va"), X("_vb")))).alias(n)
             for f, n in ((1, "needle_text"), (2, "question"), (3, "answer"))]
    cats = arr([t[0] for t in NEEDLE_TEMPLATES])
    return df.select("*", *texts, col(X(f"element_at({cats}, template_idx + 1)")).alias("template_category")).drop(
        "_nd", "_va", "_vb")


# --- GEN7: curricula (UDX2: schedules are Column -> Column) --------------------

def linear_curriculum(index: Column, total: int, lo: int, hi: int) -> Column:
    """``lo + int(min(index / total, 1) * (hi - lo))``."""
    frac = F.least(index / F.lit(max(total, 1)), F.lit(1.0))
    return (F.lit(lo) + F.floor(frac * (hi - lo))).cast("int")


def step_curriculum(index: Column, start: int = 3, every: int = 5, cap: int = 20) -> Column:
    """``min(start + index div every, cap)``."""
    return F.least(F.lit(start) + F.floor(index / every), F.lit(cap)).cast("int")


# --- GEN5, GEN6: needle examples ---------------------------------------------------

_EID = X("example_id")


def needle_examples(ids: DataFrame, seed: int, num_chunks=10, sentences_per_chunk: int = 5,
                    id_col: str = "example_id") -> DataFrame:
    """GEN6: one needle-in-haystack example per row of ``ids``.

    ``num_chunks`` is an int or a Column (e.g. a curriculum of the id).  The
    needle is inserted as its own sentence at a hashed position of a hashed
    chunk, so ``needle_text`` occurs verbatim in that chunk.  Each haystack
    sentence is a hard negative with probability 0.2 (GEN5), with values drawn
    anew for every sentence.  ``ambiguous`` flags subject-less needles whose
    template also appears as a hard negative in the same example.

    A whole example is one projection over its row (sentences and chunks by
    ``transform``), so generation is map-only.
    """
    spc = sentences_per_chunk
    n = num_chunks if isinstance(num_chunks, Column) else F.lit(num_chunks)
    df = ids.select(F.col(id_col).alias("example_id"), n.cast("int").alias("n_chunks"))
    base = with_needle(df, seed).select(
        "*", col(X(f"cast({rint(X('n_chunks'), seed, _EID, 'nc')} as int)")).alias("needle_chunk_idx"),
        col(X(f"cast({rint(spc + 1, seed, _EID, 'np')} as int)")).alias("_pos"))

    def bound(c: X, k: X, body) -> X:
        """``body`` of the digest of sentence ``k`` in chunk ``c``, made once."""
        d = var()
        return X(f"element_at(transform(array({digest(seed, _EID, 'f', c, k)}), {d} -> {body(d)}), 1)")

    c, s = var(), var()
    sentence = lambda k: bound(c, k, lambda d: X(
        f"case when {is_hard(d)} then {hard_negative(d)} else {filler_from_digest(d)} end"))
    shifted = X(f"({s} - if({c} = needle_chunk_idx and {s} > _pos, 1, 0))")
    slot = X(f"case when {c} = needle_chunk_idx and {s} = _pos then needle_text "
             f"when {c} = needle_chunk_idx or {s} < {spc} then {sentence(shifted)} end")
    chunks = X(f"transform(sequence(0, n_chunks - 1), {c} -> "
               f"array_join(transform(sequence(0, {spc}), {s} -> {slot}), ' '))")
    c2, k2 = var(), var()
    same = bound(c2, k2, lambda d: X(f"({is_hard(d)} and {_draw(d, 0, len(NEEDLE_TEMPLATES))} = template_idx)"))
    ambiguous = X(f"case when template_category = 'simple' then exists(sequence(0, n_chunks - 1), {c2} -> "
                  f"exists(sequence(0, {spc - 1}), {k2} -> {same})) else false end")
    return base.select("example_id", col(chunks).alias("context_chunks"), "needle_chunk_idx", "needle_text",
                       "question", "answer", "template_category", "template_idx", "n_chunks",
                       col(ambiguous).alias("ambiguous"),
                       F.lit(None).cast("string").alias("target_key"), F.lit(None).cast("int").alias("num_entries"))


# --- GEN8: lookup examples ------------------------------------------------------

def lookup_examples(ids: DataFrame, seed: int, num_chunks=5, entries_per_chunk: int = 5, key_length: int = 4,
                    value_length: int = 6, filler_per_chunk: int = 2, id_col: str = "example_id") -> DataFrame:
    """GEN8: key-value lookup examples with unique keys by construction.

    Keys are base-36 renderings of an affine permutation ``(a*j + b) mod
    36^L`` with ``a`` coprime to 36, so all keys of an example differ.
    Entries and filler of a chunk are interleaved by a hashed sort key.
    ``needle_text`` is the entry as rendered (its own format).
    """
    m = 36 ** key_length
    n = num_chunks if isinstance(num_chunks, Column) else F.lit(num_chunks)
    epc = entries_per_chunk
    df = ids.select(F.col(id_col).alias("example_id"), n.cast("int").alias("n_chunks"))
    df = df.withColumn("num_entries", F.col("n_chunks") * epc) \
        .withColumn("_a", col(X(f"pmod({rint(1 << 30, seed, _EID, 'a')} * 6 + 1 + 4 * {rint(2, seed, _EID, 'a2')}, "
                                f"cast({m} as bigint))"))) \
        .withColumn("_b", col(rint(m, seed, _EID, "b"))) \
        .withColumn("_t", col(rint(X("num_entries"), seed, _EID, "target")))

    def key(j):
        return X(f"lpad(lower(conv(cast(pmod(_a * {j} + _b, cast({m} as bigint)) as string), 10, 36)), "
                 f"{key_length}, '0')")

    def value(j):
        return _chars(TOKEN_ALPHABET, X(str(value_length)), seed, _EID, "val", j)

    def entry(j):
        f = rint(len(KV_FORMATS), seed, _EID, "fmt", j)
        return X(f"replace(replace(element_at({arr(KV_FORMATS)}, cast({f} + 1 as int)), '{{key}}', {key(j)}), "
                 f"'{{value}}', {value(j)})")

    c, j, s, p = var(), var(), var(), var()
    ents = (f"transform(sequence({c} * {epc}, {c} * {epc} + {epc - 1}), {j} -> "
            f"named_struct('k', md5(concat_ws(':', {lit(str(seed))}, cast(example_id as string), 'o', "
            f"cast({j} as string))), 't', {entry(j)}))")
    fill = (f"transform(sequence(0, {filler_per_chunk - 1}), {s} -> "
            f"named_struct('k', md5(concat_ws(':', {lit(str(seed))}, cast(example_id as string), 'of', "
            f"cast({c} as string), cast({s} as string))), 't', {filler_sentence(seed, _EID, 'lf', c, s)}))")
    parts = f"array_sort(concat({ents}, {fill}))" if filler_per_chunk > 0 else f"array_sort({ents})"
    chunks = X(f"transform(sequence(0, n_chunks - 1), {c} -> array_join(transform({parts}, {p} -> {p}.t), ' '))")
    t = X("_t")
    return df.select(
        "example_id", col(chunks).alias("context_chunks"),
        F.floor(F.col("_t") / epc).cast("int").alias("needle_chunk_idx"),
        col(entry(t)).alias("needle_text"),
        col(X(f"concat('Which value is stored under the key ', {key(t)}, '?')")).alias("question"),
        col(value(t)).alias("answer"),
        F.lit("lookup").alias("template_category"),
        F.lit(None).cast("int").alias("template_idx"),
        "n_chunks", F.lit(False).alias("ambiguous"),
        col(key(t)).alias("target_key"), F.col("num_entries").cast("int").alias("num_entries"))


# --- GEN9-GEN12 ---------------------------------------------------------------

def mixed_corpus(ids: DataFrame, seed: int, needle_kw: dict | None = None, lookup_kw: dict | None = None) -> DataFrame:
    """GEN9: needle examples (seed) and lookup examples (seed + 100)."""
    a = needle_examples(ids, seed, **(needle_kw or {})).withColumn("task", F.lit("needle"))
    b = lookup_examples(ids, seed + 100, **(lookup_kw or {})).withColumn("task", F.lit("lookup"))
    return a.unionByName(b, allowMissingColumns=True)


def train_eval_sets(ids: DataFrame, seed: int, total: int, lo: int = 3, hi: int = 12,
                    eval_chunks: int = 12) -> DataFrame:
    """GEN10: train (curriculum on each half's own size) and eval (fixed
    chunk count) sets with seeds s, s+100, s+1, s+2, in one job."""
    cur = linear_curriculum(F.col("example_id"), total, lo, hi)
    parts = [
        needle_examples(ids, seed, num_chunks=cur).withColumn("split", F.lit("train")).withColumn("task", F.lit("needle")),
        lookup_examples(ids, seed + 100, num_chunks=cur).withColumn("split", F.lit("train")).withColumn("task", F.lit("lookup")),
        needle_examples(ids, seed + 1, num_chunks=eval_chunks).withColumn("split", F.lit("eval")).withColumn("task", F.lit("needle")),
        lookup_examples(ids, seed + 2, num_chunks=eval_chunks).withColumn("split", F.lit("eval")).withColumn("task", F.lit("lookup")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_code(category: Column) -> Column:
    """GEN11: position in CATEGORY_NAMES, unknown -> 0."""
    pos = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_NAMES]), category)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(0)).cast("int")


def prompt_format(df: DataFrame) -> DataFrame:
    """GEN12: ``Question: ...\\nAnswer:`` prompt and the answer with a leading space."""
    return df.withColumn("prompt", F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:"))) \
             .withColumn("target", F.concat(F.lit(" "), F.col("answer")))


# --- GEN13: real text --------------------------------------------------------------

INNER_WORDS = 4
SHORT_CHARS = 3


#: bits of the filter of passage keys for each key, and its greatest size (beyond, more rows pass it)
FILTER_BITS_PER_KEY, MAX_FILTER_BITS = 16, 1 << 22


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _gram(hashes: Column, i: Column | int, n: int) -> Column:
    """Hash of ``n`` neighbouring words from their hashes."""
    return F.xxhash64(*[F.get(hashes, F.lit(i) + j if isinstance(i, int) else i + j) for j in range(n)])


def passage_keys(passages: DataFrame) -> DataFrame:
    """``item_id, _n, _h``: for each passage one key that every document containing it has.

    A passage's inner words (without the first and the last, which may be parts
    of longer words of the document) stand in the document as whole words: up
    to ``INNER_WORDS`` of them, hashed, are the key.  Passages of one or two
    words are keyed by their first characters instead (``_n`` below zero)."""
    p = passages.where(F.length("text") > 0).select("item_id", "text", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    p = p.withColumn("_k", F.least(F.size("_w") - 2, F.lit(INNER_WORDS)))
    key = reduce(lambda old, n: F.when(F.col("_k") == n, _gram(F.col("_w"), 1, n)).otherwise(old), range(1, INNER_WORDS + 1), F.lit(None).cast("bigint"))
    inner = p.where("_k >= 1 and text = trim(text) and not text rlike '^\\\\s|\\\\s$'").select("item_id", F.col("_k").alias("_n"), key.alias("_h"))
    short = p.join(inner.select("item_id"), "item_id", "left_anti").select(
        "item_id", F.least(F.length("text"), F.lit(SHORT_CHARS)).alias("_m"), "text").select(
        "item_id", (-F.col("_m")).alias("_n"), F.xxhash64(F.substr("text", F.lit(1), F.col("_m"))).alias("_h"))
    return inner.unionByName(short)


def key_filter(keys: DataFrame, n_keys: int) -> tuple[list[int], int]:
    """Bits of a filter with one hash of each key, as longs: a bit-or aggregate of at
    most ``MAX_FILTER_BITS / 64`` rows."""
    bits = 64
    while bits < min(FILTER_BITS_PER_KEY * n_keys, MAX_FILTER_BITS):
        bits *= 2
    place = F.pmod(F.col("_h"), F.lit(bits))
    rows = keys.select(F.floor(place / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(_h, 64) as int))").alias("bit"))
    longs = [0] * (bits // 64)
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).collect():
        longs[r["at"]] = r["bit"]
    return longs, bits


def _matches(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``doc_id, item_id, offset, text, passage`` of the documents that contain a passage.

    One pass over the documents: grams of all key lengths are hashed, tested against the
    filter of the keys and only then exploded, with their text, so few rows
    leave the scan and no text is read twice."""
    keys = passage_keys(passages)
    sizes = {r["_n"]: r["n"] for r in keys.groupBy("_n").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most INNER_WORDS + SHORT_CHARS rows
    if not sizes:
        kind = passages.schema["item_id"].dataType
        return documents.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(1).alias("offset"), "text",
                                F.col("text").alias("passage")).limit(0)
    longs, bits = key_filter(keys, sum(sizes.values()))
    longs = F.lit(longs)

    def passes(h: Column) -> Column:
        word = F.get(longs, F.floor(F.pmod(h, F.lit(bits)) / 64).cast("int"))
        return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1

    def found(n: int) -> Column:
        count = F.size("_w") if n > 0 else F.length("text")

        def gram(i: Column) -> Column:
            return _gram(F.col("_w"), i, n) if n > 0 else F.xxhash64(F.substr(F.col("text"), i + 1, F.lit(-n)))

        hashes = F.transform(F.sequence(F.lit(0), F.greatest(count - abs(n), F.lit(0))), gram)
        return F.transform(F.array_distinct(F.filter(hashes, passes)), lambda h: F.struct(F.lit(n).alias("_n"), h.alias("_h")))

    d = documents.where(F.length("text") > 0).select("doc_id", "text", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    grams = d.select("doc_id", "text", F.inline(F.concat(*[found(n) for n in sorted(sizes)])))
    cand = grams.join(keys, ["_n", "_h"]).join(passages.select("item_id", F.col("text").alias("passage")), "item_id")
    return cand.select("doc_id", "item_id", F.instr(F.col("text"), F.col("passage")).alias("offset"), "text", "passage").filter(F.col("offset") > 0)


def passage_matches(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents that contain a passage verbatim (``doc_id, item_id, offset``),
    whatever its length and white space: an equi-join on keys (see
    :func:`passage_keys`), then ``instr`` on the whole texts."""
    return _matches(documents, passages).select("doc_id", "item_id", "offset")


def chunk_words(text: Column, words_per_chunk: int) -> Column:
    """Split text on single spaces into chunks of ``words_per_chunk`` words
    (pass a column holding the text, so the split is not re-run per chunk)."""
    w = F.split(text, " ")
    n = F.ceil(F.size(w) / words_per_chunk).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                       lambda c: F.array_join(F.slice(w, c * words_per_chunk + 1, words_per_chunk), " "))


def real_passage_examples(documents: DataFrame, passages: DataFrame, words_per_chunk: int = 64,
                          prompt_words: int = 8) -> DataFrame:
    """GEN13 (known passage): each document holding a benchmark passage
    becomes an example; the question quotes the passage's first words, the
    answer is the next ``prompt_words`` words; the needle chunk is the chunk
    holding the passage start."""
    j = _matches(documents, passages)
    start_word = F.size(F.split(F.substring(F.col("text"), 1, F.col("offset") - 1), " ")) - 1
    pw = F.split(F.col("passage"), " ")
    return j.select(
        F.col("doc_id").alias("example_id"), "item_id",
        chunk_words(F.col("text"), words_per_chunk).alias("context_chunks"),
        F.floor(start_word / words_per_chunk).cast("int").alias("needle_chunk_idx"),
        F.col("passage").alias("needle_text"),
        F.concat(F.lit("Continue the passage: "), F.array_join(F.slice(pw, 1, prompt_words), " ")).alias("question"),
        F.array_join(F.slice(pw, prompt_words + 1, prompt_words), " ").alias("answer"),
        F.lit("definition").alias("template_category"))


def plant_facts(documents: DataFrame, seed: int, words_per_chunk: int = 64) -> DataFrame:
    """GEN13 (planting): a generated needle statement is inserted between
    two chunks of a real document at a hashed chunk position."""
    chunks = chunk_words(F.col("text"), words_per_chunk)
    df = with_needle(documents.select("doc_id", chunks.alias("_c")), seed, "doc_id", "plant")
    pos = col(X(f"cast({rint(X('size(_c)'), seed, X('doc_id'), 'plant_pos')} as int)"))
    df = df.withColumn("needle_chunk_idx", pos)
    planted = F.transform("_c", lambda c, i: F.when(i == F.col("needle_chunk_idx"),
                                                     F.concat_ws(" ", F.col("needle_text"), c)).otherwise(c))
    return df.select(F.col("doc_id").alias("example_id"), planted.alias("context_chunks"), "needle_chunk_idx",
                     "needle_text", "question", "answer", "template_category")


# --- GEN14: negatives ----------------------------------------------------------------

_STRIDE_PRIME = 2305843009213693951  # 2^61 - 1


def negative_samples(questions: DataFrame, documents: DataFrame, relevant: DataFrame, k: int,
                     seed: int) -> DataFrame:
    """GEN14: ``k`` irrelevant documents per question without a cross join.

    Documents get a dense index (skew-safe numbering); question ``q`` visits
    ``k + r_q`` distinct indices ``(start + j*stride) mod n`` (stride prime
    and larger than ``n``, so the walk has no repeats), drops its ``r_q``
    relevant documents by anti-join and keeps the first ``k`` survivors:
    exact, with exactly ``k`` negatives whenever ``n - r_q >= k``.
    """
    from corpusflow.functions.ordering import seq_number

    docs = seq_number(documents.select("doc_id"), [], [F.col("doc_id")], name="_didx")
    n = docs.count()
    if n == 0:
        return questions.select("question_id").limit(0).withColumn("doc_id", F.lit(None).cast("bigint"))
    r = relevant.groupBy("question_id").agg(F.count(F.lit(1)).alias("_r"))
    q = questions.select("question_id").join(r, "question_id", "left").fillna(0, ["_r"])
    step = _STRIDE_PRIME % n
    visits = F.least(F.col("_r") + k, F.lit(n)) - 1
    cand = q.select("question_id", F.posexplode(F.sequence(F.lit(0), visits)).alias("j", "_j")) \
        .select("question_id", "j",
                (F.pmod(col(rint(n, seed, X("question_id"), "neg")) + F.col("j") * F.lit(step), F.lit(n)) + 1)
                .alias("_didx"))
    cand = cand.join(docs, "_didx").drop("_didx")
    cand = cand.join(relevant.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
    from pyspark.sql import Window
    w = Window.partitionBy("question_id").orderBy("j")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "question_id", "doc_id", "rank")
