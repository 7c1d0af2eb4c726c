"""Operators of DataFrame functions: quality, leaks, mixing, chat."""

import hashlib
import math
import re
from collections import Counter

import pytest
from awkward import documents, empty, prose, rows
from pyspark.sql import functions as F

from corpusflow.llm import chat, leaks, mixing, quality


def quality_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_quality_counts_of_awkward_documents(spark):
    got = quality.measure(documents(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(r[0], *quality_of(r[1])) for r in rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text,kept", [
    (" ".join(f"the word{i}" for i in range(20)), True),
    (" ".join(f"word{i}" for i in range(40)), False),  # no stop word
    (" ".join(f"the word{i}***" for i in range(20)), False),  # symbols
    (" ".join(f"the w{i} !!" for i in range(20)), False),  # marks
    ("\n".join(f"the line of {i}" for i in range(9)) + "\nand so\nand so\nand so\nand so\nand so\nand so\nand so", False),
    ("the one", False), (None, False),
])
def test_each_rule_decides(spark, text, kept):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert quality.measure(df).first()["kept"] is kept
    assert quality.keep_good(df).count() == kept


def test_quality_keeps_columns_and_empty_tables(spark):
    assert quality.keep_good(documents(spark)).columns == documents(spark).columns
    assert quality.measure(empty(spark)).count() == 0


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def leaks_of(text, items):
    w = words_of(text)
    hit, names = set(), set()
    for item, t in items:
        v = words_of(t)
        size = min(len(v), 10)
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if v and tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                names.add(str(item))
    return len(w), len(hit), sorted(names)


def test_leaks_against_brute_force(spark):
    docs = rows()
    base, long = docs[0][1], docs[10][1]
    items = [(1, " ".join(base.split()[5:40])), (2, " ".join(long.split()[20_000:20_015])), (3, "two WORDS"), (4, "word"),
             (5, None), (6, ""), (7, "the the the"), (10, " ".join(base.split()[30:60])), (10, "w w"), (None, "ab ab ab ab"),
             (11, " ".join(f"q{i}" for i in range(7))), (12, "d ü äö é")]
    more = [(100, "x " + " ".join(f"q{i}" for i in range(7)) + " y"), (101, " ".join(f"q{i}" for i in range(6)))]
    df = documents(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.mark_leaks(df, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    want = []
    for d, t in [(r[0], r[1]) for r in docs] + more:
        n, h, names = leaks_of(t, [i for i in items if i[0] is not None])
        n2, h2, _ = leaks_of(t, items)
        want.append((d, n, h2, names, h2 > 0))
    assert sorted((tuple(g) for g in got), key=str) == sorted(want, key=str)
    left = leaks.drop_leaks(documents(spark), bench)
    assert left.columns == documents(spark).columns
    assert left.count() == sum(1 for r in docs if not leaks_of(r[1], items)[1])


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.mark_leaks(documents(spark), bench).where("contaminated").count() == 0
    assert leaks.mark_leaks(empty(spark), bench).count() == 0


def test_leak_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    bench = spark.createDataFrame([(1, rows()[0][1])], "item_id bigint, text string")
    want = sorted(map(str, leaks.mark_leaks(documents(spark), bench).collect()))
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    assert sorted(map(str, leaks.mark_leaks(documents(spark), bench).collect())) == want


def sources(spark, sizes, tokens=20):
    rows_ = [(i * 1000 + s, prose(i * 1000 + s, tokens), name) for s, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows_, "doc_id bigint, text string, source string").repartition(5, "doc_id")


def test_mixture_meets_its_targets(spark):
    sizes = {"hot": 600, "b": 120, "c": 100, None: 80}
    docs = sources(spark, sizes)
    plain = docs.count() * 20
    got = mixing.mix(docs, min_entropy=0.95, max_repeats=2.0, block_tokens=200)
    per = {r["source"]: r for r in got.groupBy("source").agg(
        F.sum("_tokens").alias("t"), F.max("_pass").alias("p"), F.max("_weight").alias("w")).collect()}
    share = {s: n / 900 for s, n in sizes.items()}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    assert entropy(share) < 0.95 <= entropy({s: r["w"] for s, r in per.items()}) + 1e-5
    for s, r in per.items():
        assert abs(r["t"] - r["w"] * plain) <= 20 * r["p"]  # within a document for each pass
        assert r["t"] <= 2.0 * sizes[s] * 20 + 40
    # every pass but the last holds the whole source once
    full = got.where("source = 'b' and _pass = 1")
    assert full.count() == full.select("doc_id").distinct().count() == 120
    again = mixing.mix(docs.repartition(3), min_entropy=0.95, max_repeats=2.0, block_tokens=200)
    cols = ["doc_id", "_pass", "_block"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, again.select(*cols).collect()))


def test_repeat_limit_wins(spark):
    docs = sources(spark, {"hot": 400, "tiny": 2})
    got = mixing.mix(docs, min_entropy=0.99, max_repeats=3.0, block_tokens=200)
    assert got.where("source = 'tiny'").count() <= 7
    assert got.where("source = 'tiny'").count() >= 5


def test_mixing_of_awkward_documents(spark):
    got = mixing.mix(documents(spark)).collect()
    assert all(quality_of(r["text"])[0] for r in got)
    assert set(documents(spark).columns) < set(got[0].asDict())
    assert mixing.mix(empty(spark)).count() == 0


def conversations(spark, data):
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumn("parts", chat.text_parts(F.col("text"))).withColumn("size", F.lit(1))


AWKWARD_TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None),
    (1, 3, "assistant", ""), (2, 0, "sys\ntem", "\\ \\\\ <s> [SEP] <\\s> [IMAGE] [[INST] <</s>"), (2, 1, None, "a"),
    (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, None, "assistant", "[INST]x[/INST"), (3, 5, "assistant", "[/INST]"),
    (None, 0, "user", "null id"), (4, 0, "[SEP]", "</s>\n<s>" * 500), (4, 1, "assistant", "ü你 x" * 20_000),
]


def test_chat_round_trip(spark):
    back = chat.parse_conversations(chat.format_conversations(conversations(spark, AWKWARD_TURNS)))
    got = {r["conv_id"]: [(p["role"], p["text"], p["loss"]) for p in r["parsed"]] for r in back.collect()}
    order = sorted(AWKWARD_TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv in {r[0] for r in AWKWARD_TURNS}:
        want = [(r[2] or "", r[3] or "", r[2] == "assistant") for r in order if r[0] == conv]
        assert got[conv] == want
    spans = chat.format_conversations(conversations(spark, AWKWARD_TURNS)).where("conv_id = 1").first()
    under = [spans["formatted"][t["start"]:t["start"] + t["chars"]] for t in spans["turns"] if t["loss"]]
    assert under == ["<\\/s>[\\INST] ok [\\/INST]", ""]


def test_typed_parts(spark):
    data = [(1, 0, "user", [("text", "see [IMAGE]", None, None), ("image", None, "u1", 4), ("audio", "t", "u2", None),
                            ("document", None, "u3", 2), ("odd", "kept", None, None)]),
            (1, 1, "assistant", [("text", "fine", None, None)]), (1, 2, "user", None), (1, 3, "user", [])]
    df = spark.createDataFrame(data, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(df).first()
    assert row["formatted"].startswith("<s>user[SEP][INST]see [\\IMAGE][IMAGE][AUDIO][DOCUMENT]kept[/INST]</s>")
    assert [(a["turn"], a["type"], a["ref"], a["n_tokens"]) for a in row["attachments"]] == [
        (0, "image", "u1", 1024), (0, "audio", "u2", 25), (0, "document", "u3", 1024)]
    assert row["expanded_tokens"] == 1024 + 25 + 1024
    assert [p["text"] for p in chat.parse_conversations(chat.format_conversations(df)).first()["parsed"]][1:] == ["fine", "", ""]


def test_chat_of_an_empty_table(spark):
    assert chat.format_conversations(conversations(spark, [])).count() == 0


def test_digest_of_a_turn(spark):
    from corpusflow.llm.queries_rules import op10_chat_format

    row = op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


def test_block_sums_in_two_levels(spark, monkeypatch):
    """The cut of a pass is the same however many blocks a chunk holds."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i * 7 % 40)), "abc"[i % 7 % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def mixture():
        got = mixing.mix(docs, min_entropy=0.95, max_repeats=2.0, block_tokens=50)
        return sorted((r["doc_id"], r["_pass"], r["_block"]) for r in got.collect())

    want = mixture()
    assert want
    for chunk in (1, 3):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        assert mixture() == want
