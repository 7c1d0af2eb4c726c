"""Whitening and nearest neighbours against numpy; spelling variants against plain search."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from awkward import documents
from awkward import empty as no_documents
from pyspark.sql import functions as F

from corpusflow.llm import queries_vectors, spelling, vectors, vptree, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, key string, score double"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "k", 0.5) for i, v in rows], SCHEMA).repartition(3, "vec_id")


def awkward_rows(d=6, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.5, d) + 2
    x[n // 2:n // 2 + n // 3] = x[0]  # a third of all rows are copies
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows + [(400, None), (401, []), (402, [None] * d), (403, [math.nan] + [1.0] * (d - 1)), (404, [math.inf] * d),
                   (405, [1.0] * (d - 1)), (406, [0.0] * d), (None, [1.0] * d), (20, rows[20][1]), (40, [2.5] * d), (40, rows[7][1])]


def finite(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


# ---- whitening ----

def expected_whitening(rows, d, k):
    own = finite(rows, d)
    f = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in own]
    n, s = len(f), [sum(c) for c in zip(*f)]
    y = np.array([[n * c - t for c, t in zip(v, s)] for v in f], float) / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in f]
    return own, n, values, vecs, y, deviation


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(0))
    assert np.allclose(got * sign, want, rtol=0, atol=1e-8)


@pytest.mark.parametrize("guard,degree", [(1, 4), (24, 16)])
def test_whitening_equals_dense_eigenvectors(spark, monkeypatch, guard, degree):
    monkeypatch.setattr(whitening, "GUARD", guard)
    monkeypatch.setattr(whitening, "MAX_DEGREE", degree)
    rng = np.random.default_rng(5)
    d, k = 20, 4
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((500, d)) * np.geomspace(4, 0.2, d))]
    out, model = whitening.whiten(embeddings(spark, rows), k)
    own, n, values, vecs, y, deviation = expected_whitening(rows, d, k)
    got = {r["vec_id"]: r for r in out.collect()}
    assert model.n == n == len(got) and model.residual <= 100 * whitening.TOLERANCE
    assert np.allclose(model.values, values, rtol=1e-10) and math.isclose(model.trace, (y * y).sum() / n, rel_tol=1e-12)
    assert model.identity_error < 1e-9
    assert [int(got[i]["deviation"]) for i, _ in own] == deviation
    same_up_to_sign(np.array([got[i]["whitened"] for i, _ in own]), y @ vecs / np.sqrt(values))


def test_whitening_awkward_rows(spark):
    d = 6
    rows = awkward_rows(d)
    out, model = whitening.whiten(embeddings(spark, rows), 8)
    own, n, values, vecs, y, deviation = expected_whitening(rows, d, 6)
    assert model.n == n and len(model.values) == 6
    got = out.collect()
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in own)
    want = sorted(zip([-1 if i is None else i for i, _ in own], deviation))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], int(r["deviation"])) for r in got) == want
    again = whitening.whiten(embeddings(spark, rows).repartition(7), 8)[1]
    assert np.allclose(again.vectors, model.vectors, atol=1e-9)


def test_whitening_of_extreme_and_degenerate_tables(spark):
    # values beyond 32 bits, and deviations beyond a long
    rows = [(i, [float(np.float32(c * 1e12)), float(c)]) for i, c in enumerate([1.0, -2.0, 3.5, 7.25])]
    out, model = whitening.whiten(embeddings(spark, rows), 2)
    _, _, _, _, _, deviation = expected_whitening(rows, 2, 2)
    assert [int(r["deviation"]) for r in out.orderBy("vec_id").collect()] == deviation and max(deviation) > 2**63
    # equal vectors: rows without components; one dimension; nothing
    out, model = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(int(r["deviation"]), r["whitened"]) for r in out.collect()] == [(0, [])] * 2 and model.identity_error == 0
    assert len(whitening.whiten(embeddings(spark, [(1, [1.0]), (2, [2.0])]))[1].values) == 1
    for rows in ([], [(1, None)], [(1, [])], [(1, [None, 1.0])]):
        out, model = whitening.whiten(embeddings(spark, rows))
        assert out.collect() == [] and (model is None or model.n == 0)


def test_whitening_block_widens_on_flat_spectra(spark):
    rng = np.random.default_rng(8)
    d = 48
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((3000, d)))]
    _, model = whitening.whiten(embeddings(spark, rows))
    _, _, values, _, _, _ = expected_whitening(rows, d, 8)
    assert np.allclose(model.values, values, rtol=1e-10) and model.passes < 150 and model.identity_error < 1e-8


def test_op11_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    _, n, values, vecs, y, deviation = expected_whitening([(r[0], r[1]) for r in rows], 64, 8)
    got = queries_vectors.op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 8 * len(rows) and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]]
    same_up_to_sign(table.to_numpy(), y @ vecs / np.sqrt(values))
    first = got[got["component"] == 1].set_index("vec_id").loc[[r[0] for r in rows]]
    assert first["deviation"].tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), values / ((y * y).sum() / n), rtol=1e-10)


# ---- nearest neighbours ----

def expected_neighbours(rows, d, k, asked):
    own = sorted({(i, tuple(v)) for i, v in finite(rows, d) if i is not None and any(v)})
    x = np.array([v for _, v in own])
    out = []
    for at, (i, v) in enumerate(own):
        if asked(i):
            score = x @ np.array(v)
            order = sorted((j for j in range(len(own)) if j != at), key=lambda j: (-round(score[j], 9), own[j][0]))[:k]
            out += [(i, v, r + 1, own[j][0], round(float(score[j]), 6)) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("shard_values,query_values,leaf", [(1 << 22, 1 << 24, 256), (6 * 40, 6 * 7, 4)])
def test_neighbours_are_exact_with_factor_one(spark, monkeypatch, shard_values, query_values, leaf):
    for name, value in (("SHARD_VALUES", shard_values), ("QUERY_VALUES", query_values), ("SMALL_SHARD", 60), ("ROUTED_ROWS", 20)):
        monkeypatch.setattr(vptree, name, value)
    monkeypatch.setattr(vptree.Tree.__init__, "__defaults__", (leaf, 1))
    d, k = 6, 5
    rows = awkward_rows(d)
    df = embeddings(spark, rows)
    got = vptree.nearest(df, df.where("vec_id % 10 = 0"), k).collect()
    want = expected_neighbours(rows, d, k, lambda i: i % 10 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got) == sorted((i, r, j, s) for i, _, r, j, s in want)


def test_neighbours_of_small_tables(spark):
    for rows, n in (([], 0), ([(1, None)], 0), ([(20, [1.0, 0.0])], 0), ([(20, [0.0, 0.0]), (40, [0.0, 0.0])], 0),
                    ([(20, [1.0, 2.0]), (40, [1.0, 2.0]), (60, [-3.0, 0.5])], 6)):
        df = embeddings(spark, rows)
        assert vptree.nearest(df, df.where("vec_id % 20 = 0"), 20).count() == n


def test_trees_prune_and_greater_factors_prune_more():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((40, 3))[rng.integers(0, 40, 4000)] * 5 + rng.standard_normal((4000, 3)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    radius = np.sqrt((x * x).sum(1).max())
    tree = vptree.Tree(vptree._lifted(x, radius)[1], 32)
    q, least = x[:200], np.arange(len(x))
    want = np.sort(q @ x.T, axis=1)[:, :-11:-1]
    work, recall = [], []
    for factor in (1.0, 2.0, 8.0):
        best, formed = vptree.search(tree, x, least, q, 10, radius, factor)
        work.append(formed)
        recall.append((np.sort(best.score, axis=1)[:, ::-1] >= want - 1e-9).mean())
    assert recall[0] == 1 and recall[1] > 0.9
    assert work[0] < 0.5 * 200 * 4000 and work[0] >= work[1] >= work[2]


def test_common_length(spark):
    df = embeddings(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [1.0, 2.0]), (5, None)])
    assert vectors.common_length(df, "embedding") == 2


# ---- spelling ----

def expected_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in spelling_runs(text or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def spelling_runs(text):
    out, run = [], ""
    for c in text + " ":
        if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF:
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def near_words(n):
    letters = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        one = {w[:i] + w[i + 1:] for i in range(len(w))}
        one |= {w[:i] + c + w[i + j:] for i in range(len(w) + 1) for c in letters for j in (0, 1)}
        out[w] = sorted(v for v in one if v != w and v in n)
    return out


def expected_variants(n):
    near = near_words(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def collected(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_op13_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = collected(queries_vectors.op13_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert got == expected_variants(expected_words(rows)) and any(r[1] for r in got)


def test_spelling_of_awkward_documents(spark):
    df = documents(spark)
    extra = spark.createDataFrame([(30, "Überfläche überfläche Überfläch àÀ×÷ÿÿÿÿ àÀ×÷ÿÿÿÿ", "x", "y", 1, 1, "a", "b", 1, 1, "c", 1)] * 2, df.schema)
    df = df.union(extra)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    words = spelling.vocabulary(spelling.misspelt(spelling.occurrences(df)))
    assert collected(spelling.group_variants(words)) == expected_variants(expected_words(rows))
    assert spelling.group_variants(spelling.vocabulary(spelling.misspelt(spelling.occurrences(no_documents(spark))))).collect() == []


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_crowded_buckets_lose_no_pair(spark, bucket):
    rng = np.random.default_rng(2)
    n = {"".join(rng.choice(list("abc"), 8)): int(rng.integers(2, 2000)) for _ in range(400)}
    n |= {"abcdefgh": 2, "abcdefg": 30, "abcdefgi": 400, "abcdefghj": 2, "mnopqrstu": 5, "mnopqrst": 60, "mnopqrs": 900}
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(words, bucket=bucket).collect()}
    assert got == {(w, v) for w, near in near_words(n).items() for v in near if w < v}
    if bucket == 3:
        assert collected(spelling.group_variants(words)) == expected_variants(n)


def test_signatures_are_shared_within_distance_two(spark):
    df = spark.createDataFrame([("spelling",), ("spellingx",), ("spellixg",), ("pellings",), ("entirely",)], "word string")
    sig = {r["word"]: set(r["s"]) for r in df.select("word", spelling.signatures(F.col("word")).alias("s")).collect()}
    assert all(sig["spelling"] & sig[w] for w in ("spellingx", "spellixg", "pellings"))
    assert not sig["spelling"] & sig["entirely"]
