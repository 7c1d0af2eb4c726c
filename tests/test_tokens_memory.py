"""Padding, batching, labels, memory store and refresh."""

from pyspark.sql import functions as F

from corpusflow.functions.ordering import seq_number
from corpusflow.operators import memory as mem
from corpusflow.operators import tokens as tok


def test_pad_and_mask(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1],), ([],)], "ids array<int>")
    ids, mask = tok.pad_to(F.col("ids"), 3)
    lids, lmask = tok.pad_to(F.col("ids"), 3, left=True)
    rows = df.select(ids.alias("a"), mask.alias("m"), lids.alias("la"), lmask.alias("lm")).collect()
    assert [r.a for r in rows] == [[5, 6, 7], [1, 0, 0], [0, 0, 0]]
    assert [r.m for r in rows] == [[1, 1, 1], [1, 0, 0], [0, 0, 0]]
    assert [r.la for r in rows] == [[5, 6, 7], [0, 0, 1], [0, 0, 0]]


def test_collate_batches(spark):
    rows = [(i, [[1] * (i + 1)] * (1 + i % 3), [2] * (1 + i % 4), [3] * (1 + i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, context_ids array<array<int>>, question_ids array<int>, "
                                     "answer_ids array<int>")
    b = tok.collate(tok.assign_batches(df, 4, [F.col("doc_id")]), ["batch_id"]).collect()
    by = {}
    for r in b:
        by.setdefault(r.batch_id, []).append(r)
    assert sorted(by) == [0, 1, 2] and [len(v) for _, v in sorted(by.items())] == [4, 4, 2]
    for rs in by.values():
        assert len({len(r.question_input_ids) for r in rs}) == 1
        assert len({len(r.context_input_ids) for r in rs}) == 1
        assert len({len(c) for r in rs for c in r.context_input_ids}) == 1
        for r in rs:
            assert sum(r.question_mask) == len(r.question_ids)
            assert sum(sum(m) for m in r.context_attention_mask) == sum(len(c) for c in r.context_ids)


def test_teacher_forcing_ignores_padding(spark):
    df = spark.createDataFrame([([1, 2], [7, 8, 0], [1, 1, 0])], "q array<int>, a array<int>, m array<int>")
    ids, labels = tok.teacher_forcing(F.col("q"), F.col("a"), F.col("m"))
    r = df.select(ids.alias("i"), labels.alias("l")).first()
    assert r.i == [1, 2, 7, 8, 0] and r.l == [-100, -100, 7, 8, -100]


def test_seq_number_hot_key(spark):
    rows = [(0 if i % 3 == 0 else i % 17, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int")
    for parts in (1, 2, 8):
        got = {(r.k, r.v): r.rn for r in seq_number(df, ["k"], [F.col("v")], n_parts=parts).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            for n, v in enumerate(sorted(v for kk, v in rows if kk == k), 1):
                want[(k, v)] = n
        assert got == want


def test_memory_store_ops(spark):
    store = spark.createDataFrame([(1, "/a/1", 1), (2, "/b/2", 1)], "doc_id long, path string, version long")
    new = spark.createDataFrame([(2, "/b/2", 3), (2, "/b/2", 2), (3, "/a/3", 1)], "doc_id long, path string, version long")
    s2 = mem.add_entries(store, new)
    assert {(r.doc_id, r.version) for r in s2.collect()} == {(1, 1), (2, 3), (3, 1)}
    ids = spark.createDataFrame([(1,), (9,)], "doc_id long")
    assert {r.doc_id: r.path for r in mem.get_entries(s2, ids).collect()} == {1: "/a/1", 9: None}
    left, found = mem.remove_entries(s2, ids)
    assert left.count() == 2 and {r.doc_id: r.found for r in found.collect()} == {1: True, 9: False}
    assert {r.doc_id for r in mem.by_scope(s2, prefix="/a/").collect()} == {1, 3}
    assert {r.doc_id for r in mem.by_scope(s2, glob="/?/3").collect()} == {3}


def test_summary_is_last_token_and_empty_docs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, ""), (3, "  ")], "doc_id long, text string")
    ch = mem.chunk_tokens(docs, 2)
    assert {(r.doc_id, r.chunk_idx) for r in ch.collect()} == {(1, 0), (1, 1)}
    t = mem.token_table(ch, ["doc_id", "chunk_idx"])
    s = {(r.doc_id, r.chunk_idx): r.summary for r in mem.summaries(t, ["doc_id", "chunk_idx"]).collect()}
    gamma = spark.createDataFrame([("gamma",)], "t string").select(mem.hashed_vector(F.col("t")).alias("v")).first().v
    assert s[(1, 1)] == gamma


def test_refresh_encodes_only_changes(spark):
    cur = spark.createDataFrame([(1, "same"), (2, "changed"), (3, "new")], "doc_id long, text string")
    prev = spark.createDataFrame([(1, "same"), (2, "old"), (4, "gone")], "doc_id long, text string") \
        .select("doc_id", F.sha2("text", 256).alias("content_hash"))
    enc, kept, dropped = mem.refresh_plan(cur, prev)
    assert {r.doc_id for r in enc.collect()} == {2, 3}
    assert {r.doc_id for r in kept.collect()} == {1}
    assert {r.doc_id for r in dropped.collect()} == {4}


def test_quantize_error_bound(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25, 0.0],)], "v array<double>")
    codes, scale, deq = mem.quantize(F.col("v"), bits=4)
    mx, _ = mem.quantization_error(F.col("v"), deq)
    r = df.select(codes.alias("c"), scale.alias("s"), mx.alias("m")).first()
    assert r.c[1] == -7 and abs(r.s - 1 / 7) < 1e-12 and r.m <= r.s / 2 + 1e-12


def test_plugged_in_encoder_leaves_other_columns_alone(spark):
    from corpusflow.plans.memory_plans import _md5_vectors

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (3, "a")], "doc_id long, token string").coalesce(1)
    got = mem.pandas_encoder(_md5_vectors, mem.HASH_DIM)(df).collect()
    assert [(r.doc_id, r.token) for r in got] == [(big, "a"), (None, "b"), (3, "a")]
    want = df.select(mem.hashed_vector(F.col("token"))).collect()
    assert [r.vec for r in got] == [r[0] for r in want]
    assert mem.pandas_encoder(_md5_vectors, mem.HASH_DIM)(df.where("token = 'c'")).count() == 0


def test_one_digest_for_each_different_token(monkeypatch):
    import hashlib

    import pandas as pd

    from corpusflow.plans.memory_plans import _md5_vectors

    made, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda b: made.append(b) or md5(b))
    out = _md5_vectors(pd.Series(["a", "b", "a", "a"]))
    assert out.shape == (4, mem.HASH_DIM) and (out[0] == out[2]).all() and (out[0] != out[1]).any()
    assert sorted(made) == [b"a", b"b"]
    assert _md5_vectors(pd.Series([], dtype=object)).shape == (0, mem.HASH_DIM)
