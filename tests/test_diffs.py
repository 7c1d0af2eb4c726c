"""Line diffs, retention, renames, pruning and packed codes against plain computation."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators import catalog as cat
from corpusflow.operators import diffs, memory, renames, retention, routing, sketches


def distance(a, b, replace):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cost = [prev[j] + 1, cur[j - 1] + 1]
            if x == y or replace:
                cost.append(prev[j - 1] + (x != y))
            cur.append(min(cost))
        prev = cur
    return prev[-1]


def patched(old, text):
    """The old lines with a unified diff applied."""
    out, at = [], 0
    for line in text.split("\n")[3:-1]:
        if line.startswith("@@ "):
            start, n = map(int, line.split()[1][1:].split(","))
            begin = start - 1 if n else start
            out += old[at:begin]
            at = begin
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            if line[0] == " ":
                out.append(line[1:])
            at += 1
    return out + old[at:]


LINES = st.lists(st.sampled_from(["", "a", "b", "c", "+", "-x", "@@ y", " d"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(LINES, LINES)
def test_diffs_are_minimal_and_apply(a, b):
    assert diffs.line_distance(a, b) == distance(a, b, True)
    pairs = diffs.matches(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(a) + len(b) - 2 * len(pairs) == distance(a, b, False)
    old, new = "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)
    text, added, removed = diffs.unified("f", old, new)
    assert (added, removed) == (len(b) - len(pairs), len(a) - len(pairs))
    if text:
        assert patched(a, text) == b


def test_long_texts_stay_quick():
    rng = random.Random(3)
    a = [str(rng.randrange(500)) for _ in range(20_000)]
    b = [x for x in a if rng.random() < 0.9]
    assert len(diffs.matches(a, b)) == len(b)
    assert diffs.line_distance(a, b) == len(a) - len(b)


def test_commit_diffs_of_roots_deletions_and_unknown_parents(spark):
    commits = spark.createDataFrame([("r", "1", None), ("r", "2", "1"), ("r", "3", "2"), ("r", "9", "gone")], "repo string, sha string, parent_sha string")
    blobs = spark.createDataFrame([("r", "1", "a", "x\ny\n"), ("r", "1", "b", "same"), ("r", "2", "a", "x\nz\n"), ("r", "2", "b", "same"),
                                   ("r", "3", "b", "same"), ("r", "9", "c", "n\n")], "repo string, sha string, path string, content string")
    got = {r["sha"]: (r["files_changed"], r["additions"], r["deletions"], r["diff"]) for r in diffs.commit_diffs(commits, blobs).collect()}
    assert got["1"][:3] == (["a", "b"], 3, 0) and "--- /dev/null\n+++ b/a\n@@ -0,0 +1,2 @@\n+x\n+y\n" in got["1"][3]
    assert got["2"] == (["a"], 1, 1, "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n")
    assert got["3"][:3] == (["a"], 0, 2) and "+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-z\n" in got["3"][3]
    assert got["9"][:3] == (["c"], 1, 0)


def test_line_similarity_of_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("a\nb\n", "a\nb"), ("a\nb", "a\nc\nd\n"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(diffs.line_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 1.0, 1.0] and abs(got[3] - 1 / 3) < 1e-12 and got[4] == 0.0


def test_line_names(spark):
    long = "x" * 10_000
    digest = hashlib.sha256(long.encode()).hexdigest()
    texts = [None, "", "\n", "a\n\nb", f"{long}\n{digest}\n", f"{long}y\n{long}", "\u00e4" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(diffs.line_names(F.col("t"))).collect()]
    assert [len(x) for x in got] == [len(diffs.lines_of(t)) for t in texts]
    assert got[3] == ["a", "", "b"] and all(len(x) <= diffs.DIGEST for names in got for x in names)
    own = {x: y for t, names in zip(texts, got) for x, y in zip(diffs.lines_of(t), names)}
    assert len(set(own.values())) == len(own)  # equal names for equal lines only
    assert own[long] == digest != own[digest]


@pytest.mark.parametrize("bins", [1, 2, 1024])
def test_retention_equals_sorting(spark, bins):
    rng = random.Random(7)
    rows = [(q, p, rng.choice([0.0, 0.5, rng.random(), 1e-9 * rng.random()]), rng.random() < 0.2) for q, n in enumerate([1, 5, 60, 300]) for p in range(n)]
    rows += [(9, p, 0.25, p % 2 == 0) for p in range(80)]  # all weights equal
    df = spark.createDataFrame(rows, "q int, pos int, weight double, is_answer boolean").repartition(5)
    got = {(r["q"], r["budget"]): (r["answer_tokens"], r["kept"]) for r in retention.retained(df, [1, 25, 50], ["q"], bins=bins).collect()}
    want = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        for m in (1, 25, 50):
            want[q, m] = (sum(r[3] for r in own), sum(r[3] for r in own[:m]))
    assert got == want


def test_retention_ranks_without_joining_tokens(spark):
    df = spark.createDataFrame([(q, p, p / 7, p % 3 == 0) for q in (1, None) for p in range(40)], "q int, pos int, weight double, is_answer boolean")
    got = retention.retained(df, [5, 2], ["q"])
    assert {tuple(r) for r in got.collect()} == {(1, 5, 14, 2), (1, 2, 14, 1)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # totals with ranks, a row for each query


@pytest.mark.parametrize("bins", [1, 64])
def test_retention_beyond_ranked_budgets(spark, bins):
    rng = random.Random(3)
    rows = [(q, p, rng.choice([0.5, rng.random()]), rng.random() < 0.2) for q, n in enumerate([1, 400, 1500]) for p in range(n)]
    df = spark.createDataFrame(rows, "q int, pos int, weight double, is_answer boolean").repartition(5)
    got = {(r["q"], r["budget"]): (r["answer_tokens"], r["kept"]) for r in retention.retained(df, [10, 1200], ["q"], bins=bins).collect()}
    for q in range(3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        for m in (10, 1200):
            assert got[q, m] == (sum(r[3] for r in own), sum(r[3] for r in own[:m]))


def test_rename_batches(spark):
    names = ["o/a", "o/b", "o/c", "s/1", "s/2", "k/1", "k/2", "k/3", "p/a", "t/1", "t/2", "stay/x", "b/1", "b/2", "m/1", "self/x", "u/1"]
    catalog = spark.createDataFrame([(n, *n.split("/")) for n in names], "full_name string, owner string, name string")
    batch = [("o/a", "o/b"), ("o/b", "o/c"), ("o/c", "o/new"),  # a chain into a free name
             ("s/1", "s/2"), ("s/2", "s/1"),  # a swap
             ("k/1", "k/2"), ("k/2", "k/3"), ("k/3", "k/1"),  # a circle of three
             ("p/a", "gone/b"), ("gone/b", "gone/c"), ("gone/c", "final/d"),  # redirects over names that are no rows
             ("t/1", "free/t"), ("t/2", "free/t"),  # two want one name
             ("b/1", "b/2"), ("b/2", "stay/x"),  # blocked by a row that stays
             ("m/1", "loop/1"), ("loop/1", "loop/2"), ("loop/2", "loop/1"),  # redirects that never end
             ("self/x", "self/x"), ("none/y", "none/z"), ("u/1", "t/2")]  # no change, no such row, name of a row that lost
    got = cat.rename(catalog, spark.createDataFrame(batch, "old_name string, new_name string")).collect()
    now = {r["renamed_from"]: r["full_name"] for r in got if r["renamed_from"]}
    assert now == {"o/a": "o/b", "o/b": "o/c", "o/c": "o/new", "s/1": "s/2", "s/2": "s/1", "k/1": "k/2", "k/2": "k/3", "k/3": "k/1",
                   "p/a": "final/d", "t/1": "free/t"}
    assert {r["full_name"] for r in got if r["rename_refused"]} == {"t/2", "b/1", "b/2", "m/1", "u/1"}
    assert len({r["full_name"] for r in got}) == len(names)
    assert all(f"{r['owner']}/{r['name']}" == r["full_name"] for r in got)


def test_long_chain_of_renames(spark):
    catalog = spark.createDataFrame([(f"c/{i}", "c", str(i)) for i in range(70)], "full_name string, owner string, name string")
    batch = spark.createDataFrame([(f"c/{i}", f"c/{i + 1}") for i in range(70)], "old_name string, new_name string")
    got = {r["renamed_from"]: r["full_name"] for r in cat.rename(catalog, batch).collect()}
    assert got == {f"c/{i}": f"c/{i + 1}" for i in range(70)}


def test_swaps_are_not_followed_round_and_round(spark, monkeypatch):
    pairs = [(f"s/{i}", f"s/{i ^ 1}") for i in range(400)]
    names = spark.createDataFrame([(a,) for a, _ in pairs], "full_name string")
    batch = spark.createDataFrame(pairs, "old_name string, new_name string")
    kept, made = renames._kept, []
    monkeypatch.setattr(renames, "_kept", lambda df: made.append(kept(df)) or made[-1])
    got = renames.resolve(names, batch)
    assert {(r["old_name"], r["new_name"], r["refused"]) for r in got.collect()} == {(a, b, False) for a, b in pairs}
    assert len(made) <= 4  # pointers, moves, states and one join that ends nothing
    for df in made:  # estimates are those of files: no product of products
        assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 30


def test_names_of_several_rows(spark):
    names = spark.createDataFrame([("a/x",)] * 3 + [("b/y",)] * 2 + [(None,)], "full_name string")
    batch = spark.createDataFrame([("a/x", "b/y"), ("b/y", "a/x"), (None, "c/z")], "old_name string, new_name string")
    got = renames.resolve(names, batch).collect()
    assert sorted((r["old_name"], r["new_name"], r["refused"]) for r in got) == [("a/x", "b/y", False), ("b/y", "a/x", False)]


def test_pruned_top_k_skips_blocks_and_keeps_the_rows(spark):
    rng = random.Random(4)
    docs = []
    for i in range(600):  # sixteen tight clusters at the corners of four coordinates
        corner = [1.0 if (i % 16) >> b & 1 else -1.0 for b in range(4)]
        docs.append((i % 2, i, [c + rng.gauss(0, 0.02) for c in corner] + [rng.gauss(0, 0.02) for _ in range(4)]))
    queries = [(g, g * 10 + j, 0, [rng.choice([1.0, -1.0]) for _ in range(4)] + [0.1] * 4) for g in (0, 1) for j in range(5)]
    d = spark.createDataFrame(docs, "group_id int, doc_id long, key array<double>")
    q = spark.createDataFrame(queries, "group_id int, query_id int, pos int, q array<double>")
    top, stats = routing.pruned_top_k(q, d, 7, 8)
    want = set()
    for g, i, p, v in queries:
        own = sorted(((-sum(a * b for a, b in zip(v, k)) / 8 ** 0.5, doc) for h, doc, k in docs if h == g))[:7]
        want |= {(g, i, p, doc, r + 1) for r, (_, doc) in enumerate(own)}
    assert {(r["group_id"], r["query_id"], r["pos"], r["doc_id"], r["rank"]) for r in top.collect()} == want
    s = stats.first()
    assert s["pairs"] == 10 * 300 and s["scored"] < 0.5 * s["pairs"]
    # fewer documents than k, one of a group without documents
    few = spark.createDataFrame(docs[:3], "group_id int, doc_id long, key array<double>")
    assert routing.pruned_top_k(q, few, 7, 8)[0].count() == 5 * 2 + 5 * 1


@pytest.mark.parametrize("dim", [1, 2, 7, 8, 13, 64])
def test_packed_codes(spark, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.randint(-7, 7) for _ in range(dim)], [rng.randint(-127, 127) for _ in range(dim)]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, codes array<int>, q array<int>")
    p = df.select("i", "q", memory.pack4(F.col("codes"), dim).alias("p"))
    got = {r["i"]: (r["n"], r["s"]) for r in p.select("i", F.octet_length("p").alias("n"), memory.packed_dot(F.col("p"), F.col("q"), dim).alias("s")).collect()}
    assert got == {i: ((dim + 1) // 2, sum(a * b for a, b in zip(c, q))) for i, c, q in rows}


def test_sketches_roll_up(spark):
    df = spark.range(20_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 7000).cast("string").alias("name")).union(
        spark.range(1).select(F.lit(1).cast("bigint"), F.lit(None).cast("string")))
    per_day = sketches.distinct_sketches(df, [F.col("day")], "name")
    month = sketches.rolled_up(per_day, [F.floor(F.col("day") / 10).alias("m")])
    exact = {r[0]: r[1] for r in df.groupBy(F.floor(F.col("day") / 10)).agg(F.countDistinct("name")).collect()}
    for r in month.collect():
        assert abs(r["estimate"] - exact[r["m"]]) <= 4 * sketches.STANDARD_ERROR * exact[r["m"]]
