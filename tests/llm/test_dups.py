"""Duplicate operators and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from awkward import documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from test_rules import leaks_of
from tokenizers import Tokenizer

from corpusflow.llm import neardup, runindex
from corpusflow.llm.common import keep_dealt


# ---- repeated strings ----

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=60), st.booleans())
def test_matching_statistics(symbols, twice):
    text = np.array(symbols + ([3] + symbols[: len(symbols) // 2] if twice else []))
    n = len(text)

    def common(i, j):
        k = 0
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    assert list(runindex.suffix_array(text)) == sorted(range(n), key=lambda i: tuple(text[i:]))
    assert list(runindex.matching_statistics(text, n)) == [max(common(i, j) for j in range(n) if j != i) for i in range(n)]


def test_runs_stay_few_in_repetitive_texts():
    once = np.random.default_rng(1).integers(1, 200, 3000)
    text = np.concatenate([once, [0], once, [0], once, [0], once])
    tail, head = runindex.run_samples(text, runindex.suffix_array(text))
    assert len(tail) == len(head) < 1.1 * len(once)


@pytest.mark.parametrize("parts", runindex.LEVELS)
def test_equal_windows_have_equal_keys(parts):
    a, b = prose(1, 400).encode(), prose(2, 300).encode()
    texts = [a, b"head " + a[100:900] + b"tail" + b, b"", b"short", a[:50] * 40]
    for length in (100, 400):
        found = {}
        doc, first, n, key, _ = runindex.fragments(texts, length, parts)
        covered = Counter()
        for d, s, m, k in zip(doc, first, n, key):
            for i in range(s, s + m):
                covered[d, i] += 1
                assert found.setdefault(texts[d][i:i + length], k) == k
        assert covered == {(d, i): 1 for d, t in enumerate(texts) for i in range(len(t) - length + 1)}


def removed(texts, length):
    where = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if where[t[i:i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(t), len(gone), runs, hashlib.sha256(bytes(c for i, c in enumerate(t) if i not in gone)).hexdigest()))
    return out


def repeats(spark, texts, length, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got = runindex.remove_repeats(df, length).collect()
    return [tuple(r)[1:4] + (hashlib.sha256(r["kept"]).hexdigest(),) for r in sorted(got, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(runindex, "GROUP", group)
    rng = random.Random(3)
    passage = prose(50, 18)  # a passage in many documents, each time within other words
    base = prose(51, 120)
    texts = [prose(i, rng.randrange(5, 40)) + passage + prose(1000 + i, rng.randrange(5, 40)) for i in range(40)]
    for i in range(20):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += ["ab" * 400, "z" * 300, "ü" * 90, "", "x", base, base, prose(60, 30) * 2, "q" * 80 + prose(61, 20)]
    assert repeats(spark, texts, 100) == removed([t.encode() for t in texts], 100)


def test_runs_of_one_byte_beyond_the_group(spark, monkeypatch):
    monkeypatch.setattr(runindex, "GROUP", 3)
    lengths = [100, 101, 103, 107, 112, 118, 125, 133, 142, 152, 250, 2400]
    texts = [prose(300 + i, 8) + f"<{i}" + "-" * n + f"{i}>" + prose(400 + i, 9) for i, n in enumerate(lengths)]
    texts += [prose(500 + i, 6) + " " * (99 + i) + prose(600 + i, 6) for i in range(8)]  # the first has no whole window
    texts += ["0" * 130, prose(520, 5) + "=" * 101]
    assert repeats(spark, texts, 100) == removed([t.encode() for t in texts], 100)


def test_repeats_of_awkward_documents(spark):
    got = runindex.remove_repeats(documents(spark)).collect()
    want = removed([(r[1] or "").encode() for r in rows()], 400)
    mine = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(mine, key=str) == sorted([(r[0], *w) for r, w in zip(rows(), want)], key=str)
    assert all(r["n_removed"] == sum(e - s for s, e in r["spans"]) for r in got)
    assert runindex.remove_repeats(empty(spark)).count() == 0


# ---- near copies ----

def shingle_set(text, width):
    low = (text or "").encode().lower().split()
    if not low:
        return frozenset()
    k = min(width, len(low))
    return frozenset(tuple(low[i:i + k]) for i in range(len(low) - k + 1))


def linked(texts, width, percent):
    """Component (least index) of each text, by comparing all pairs."""
    sets = [shingle_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sets


def near_texts():
    rng = random.Random(5)
    texts = [prose(i, rng.randrange(1, 80)) for i in range(60)]
    for g, (n, edits) in enumerate([(60, 1), (30, 4), (20, 9), (12, 16)]):  # groups, some below the threshold
        base = prose(100 + g, 150).split(" ")
        for i in range(n):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w))
    chain = prose(200, 160).split(" ")
    for i in range(25):  # links that only hold from one to the next
        texts.append(" ".join(chain[i * 3:i * 3 + 80]))
    return texts + ["", None, " \n", "One two", "one TWO", "one", "Ä b c d e", "ä b c d e"] + texts[60:70]


@pytest.mark.parametrize("width,threshold,node,group,depth", [
    (3, 0.85, 64, 1000, 16), (3, 0.85, 4, 1000, 16), (5, 0.8, 4, 10, 16), (3, 0.85, 2, 2, 1)])
def test_components_against_all_pairs(spark, monkeypatch, width, threshold, node, group, depth):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "MAX_DEPTH", depth)
    texts = near_texts()
    want, sets = linked(texts, width, round(100 * threshold))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in neardup.link_documents(df, width, threshold).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_copies_of_awkward_documents(spark):
    got = neardup.keep_one(documents(spark), 3, 0.85)
    assert got.columns == documents(spark).columns
    kept = Counter(r["doc_id"] for r in got.collect())
    # 1 stands for its copies and 3; equal rows are one; texts that share an id stay apart
    assert kept == Counter({1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 2, 15: 1, 16: 1, None: 2})
    assert neardup.link_documents(empty(spark)).count() == 0
    assert neardup.keep_one(empty(spark)).count() == 0


def test_recall_of_the_trees():
    assert neardup.survival(0.85, 0) == 1
    for threshold in (0.8, 0.85):
        trees = neardup.trees_for(threshold)
        assert (1 - neardup.survival(threshold, neardup.RECALL_DEPTH)) ** trees <= 1 - neardup.RECALL


def test_trees_for_the_depth_reached(spark, monkeypatch):
    for threshold in (0.8, 0.85):
        for depth in range(1, neardup.MAX_DEPTH + 2):
            trees = neardup.trees_for(threshold, neardup.RECALL, depth)
            assert (1 - neardup.survival(threshold, depth)) ** trees <= 1 - neardup.RECALL
        used = [c for _, c in neardup.roots(trees, threshold)]
        assert len(set(used)) == len(used)
    for name, value in {"NODE": 4, "GROUP": 70, "RECALL_DEPTH": 1}.items():
        monkeypatch.setattr(neardup, name, value)
    asked, more_trees = [], neardup.more_trees
    monkeypatch.setattr(neardup, "more_trees", lambda *a: asked.append(a[-2:]) or more_trees(*a))
    template = [f"t{i}" for i in range(70)]  # in all documents, links none of them
    texts = []
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(30)]
        texts += [" ".join(template + own), " ".join(template + own[8:] + [f"g{g}y{i}" for i in range(8)])]
    want, _ = linked(texts, 1, 85)
    assert want == [i - i % 2 for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link_documents(df, 1, 0.85).collect()}
    assert [got[i] for i in range(120)] == want
    assert asked and asked[-1][1] > neardup.trees_for(0.85)


def test_stars_find_long_chains(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(0, 100) if i % 33] + [(b"900", b"905"), (b"901", b"905")]
    got = {bytes(r["id"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {r for r in got.values()} == {b"001", b"034", b"067", b"900"}
    assert got[b"033"] == b"001" and got[b"066"] == b"034" and got[b"099"] == b"067"
    assert got[b"901"] == got[b"905"] == b"900"


# ---- the pipeline ----

def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from test_rules import quality_of

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    from corpusflow.llm.quality import STOP_WORDS

    def good(t):
        n, chars, symbols, dup, _, failed = quality_of(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return (not failed and 2.5 <= chars / n <= 12 and symbols <= 0.1 * n and len(re.findall("[!?]", t)) <= 0.5 * n
                and sum(x in STOP_WORDS for x in w) >= 0.01 * n and dup <= 0.3 * len(lines)
                and sum(x.rstrip(" ").endswith("|") for x in lines) <= 0.5 * len(lines))

    kept = sorted((d for d in docs if good(d["text"] or "x")), key=lambda d: d["doc_id"])
    roots, _ = linked([d["text"] for d in kept], 5, 80)
    kept = [d for i, d in enumerate(kept) if roots[i] == i]
    kept = [d for d in kept if not leaks_of(d["text"], items)[1]]
    stages = {}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf).cache()
        stages[name] = frame
        if name != "token_output":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "benchmark_leaks":
            assert sorted(r["doc_id"] for r in frame.collect()) == [d["doc_id"] for d in kept]
    mixed = sorted(stages["source_mix"].collect(), key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in mixed} <= {d["doc_id"] for d in kept}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in mixed:
        ids = np.array(tok.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, frame.collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


@pytest.mark.parametrize("key", ["op2_quality_rules", "op4_source_mixing", "op7_benchmark_decontamination", "op10_chat_format",
                                 "op12_vantage_point_search", "op13_spelling_variants"])
def test_oracles(spark, key):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from oracle_harness import check, duck_con

    from corpusflow.llm.registry import all_queries

    sf = "/root/testdata/sf0.001"
    r = check(spark, duck_con(sf), key, all_queries()[key], sf)
    assert r["status"] == "ok", r


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for frame in (documents(spark), empty(spark)):
        columns = frame.columns
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
            if name != "token_output":
                assert frame.columns == columns
        assert frame.columns[:3] == ["doc_id", "start", "n_tokens"]
        assert frame.count() >= 0


def test_dealt_texts_stay_where_they_are(spark):
    """Confirming links moves the pairs, never the whole table of texts."""
    big = spark.range(3000).selectExpr("cast(cast(id as string) as binary) as id", "repeat(cast(id as string), 9) as text")
    tables = spark.catalog.listTables()
    texts = keep_dealt(big, "test-texts", "id")
    assert spark.catalog.listTables() == tables
    assert texts.schema.names == ["id", "text"] and texts.count() == 3000
    pairs = spark.range(0, 3000, 10).selectExpr("cast(cast(id as string) as binary) as a", "cast(cast(id + 1 as string) as binary) as b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = neardup.confirm(pairs, texts, 3, 85)
        plan = links._jdf.queryExecution().executedPlan().toString()
        links.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(moved) == 2, plan  # the pairs, once for each end


def test_workers_keep_no_words():
    """What a worker holds is gone over by the collector after every task."""
    import tracemalloc

    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(40)]
    tracemalloc.start()
    try:
        neardup.shingles(texts[0], 3)
        before = tracemalloc.get_traced_memory()[0]
        assert [len(neardup.shingles(t, 3)) for t in texts] == [998] * 40
        assert tracemalloc.get_traced_memory()[0] - before < 1_000_000
    finally:
        tracemalloc.stop()


def test_candidates_are_packed_once(spark, monkeypatch):
    """Links are confirmed on sets taken apart once, from buckets by their bytes and not by the shuffle's partitions."""
    seen, confirm = [], neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda pairs, sets, *a: seen.append(sets) or confirm(pairs, sets, *a))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(8 * cores))
    try:
        texts = [t for t in near_texts() if t]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
        got = {r["doc_id"]: r["component_id"] for r in neardup.link_documents(df, 3, 0.85).collect()}
        assert [got[i] for i in range(len(texts))] == linked(texts, 3, 85)[0]
        sizes = [neardup._buckets(spark, n * neardup.BUCKET) for n in (0, 3 * cores, 99 * cores)]
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        assert neardup._buckets(spark, 0) == 211  # no other number divides it
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sizes == [2 * cores, 4 * cores, 8 * cores]
    assert seen and all(s.columns == ["id", "packed"] for s in seen)
    buckets = {int(re.search(r"_(\d{5})\.c", f)[1]) for f in seen[0].inputFiles()}
    assert cores < len(buckets) <= 2 * cores and max(buckets) < 2 * cores
    stored = {bytes(r["id"]): bytes(r["packed"]) for r in seen[0].collect()}
    assert all(hashlib.blake2b(p, digest_size=16).digest() == i for i, p in stored.items())


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_find_all_links(spark, percent):
    """One node of sets with many edits: every link is among the pairs, which are not all there are."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 26)):
            w[at] = f"e{rng.randrange(40)}x{at}"
        texts.append(" ".join(w[:rng.randrange(100, 121)]))
    sets = [neardup.shingles(t, 1) for t in texts]
    ids = [b"%03d" % i for i in range(60)]
    rows_ = [(1, i, len(s), *neardup.bits(neardup.minima(s)), i, None) for i, s in zip(ids, sets)]
    node = spark.createDataFrame(rows_, "node bigint, id binary, n bigint, b0 bigint, b1 bigint, label binary, tag string")
    packed = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(ids, sets)], "id binary, packed binary")
    asked = neardup._rare_pairs(node, packed, percent / 100)
    got = {(bytes(a), bytes(b)) for a, b in asked.collect()}
    share = {(ids[i], ids[j]): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for j in range(60) for i in range(j)}
    links = {p for p, x in share.items() if round(x * 10000) >= percent * 100}
    assert links and links <= got < set(share)
