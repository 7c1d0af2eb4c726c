"""Retrieval properties: probabilities sum to 1, empty memory, gate."""

import math

from pyspark.sql import functions as F

from corpusflow.operators import routing as ret


def _mem(spark):
    docs = spark.createDataFrame(
        [(1, d, [float((d * 7 + j) % 5 - 2) for j in range(8)], [float(d + j) for j in range(8)]) for d in range(6)],
        "group_id int, doc_id long, key array<double>, value array<double>")
    q = spark.createDataFrame([(1, 10, 0, [0.5] * 8), (1, 10, 1, [-0.25] * 8), (2, 20, 0, [1.0] * 8)],
                              "group_id int, query_id long, pos int, q array<double>")
    return docs, q


def test_scores_sum_to_one(spark):
    docs, q = _mem(spark)
    lg = ret.coarse_logits(q, docs, 2, 4)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    sums = {r.query_id: r.s for r in sc.groupBy("query_id").agg(F.sum("score").alias("s")).collect()}
    assert set(sums) == {10}  # query of group 2 has no documents -> no rows
    assert abs(sums[10] - 1.0) < 1e-9


def test_softmax_matches_python(spark):
    docs, q = _mem(spark)
    lg = ret.coarse_logits(q.filter("pos = 0"), docs, 1, 8)
    pr = {r.doc_id: r.p for r in ret.softmax(lg, ["query_id", "pos", "head"]).collect()}
    logits = {r.doc_id: sum(0.5 * k for k in r.key) / math.sqrt(8) for r in docs.collect()}
    z = sum(math.exp(v) for v in logits.values())
    for d, v in logits.items():
        assert abs(pr[d] - math.exp(v) / z) < 1e-12


def test_gate_closed_returns_base(spark):
    df = spark.createDataFrame([([1.0, 2.0], [5.0, -5.0])], "b array<double>, c array<double>")
    out = df.select(ret.gated_blend(F.col("b"), F.col("c"), -60.0).alias("o")).first().o
    assert all(abs(a - b) < 1e-12 for a, b in zip(out, [1.0, 2.0]))


def test_weighted_context(spark):
    docs, q = _mem(spark)
    sc, ctx = ret.coarse_round(q.filter("pos = 0 and group_id = 1"), docs, 2, 4)
    c = ctx.first().context
    assert len(c) == 8
    pr = ret.softmax(ret.coarse_logits(q.filter("pos = 0 and group_id = 1"), docs, 2, 4),
                     ["group_id", "query_id", "pos", "head"]).collect()
    vals = {r.doc_id: r.value for r in docs.collect()}
    want = [0.0] * 8
    for r in pr:
        for j in range(4):
            want[r.head * 4 + j] += r.p * vals[r.doc_id][r.head * 4 + j]
    assert all(abs(a - b) < 1e-9 for a, b in zip(c, want))
