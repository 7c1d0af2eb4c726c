"""Generator properties (needle, lookup, curriculum, determinism)."""

from pyspark.sql import functions as F

from corpusflow.operators import corpora as gen


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "example_id")


def test_needle_structure(spark):
    rows = gen.needle_examples(_ids(spark, 100), 42, num_chunks=5, sentences_per_chunk=3).collect()
    assert len(rows) == 100
    for r in rows:
        assert len(r.context_chunks) == 5
        assert 0 <= r.needle_chunk_idx < 5
        assert r.question and r.answer
        assert r.needle_text in r.context_chunks[r.needle_chunk_idx]
        assert r.template_category in gen.CATEGORY_NAMES
    assert len({r.question for r in rows}) > 5
    assert len({r.answer for r in rows[:20]}) >= 10


def test_templates_and_categories():
    assert len(gen.NEEDLE_TEMPLATES) >= 20
    cats = {t[0] for t in gen.NEEDLE_TEMPLATES}
    assert len(cats) == 7 and "lookup" not in cats


def test_hard_negative_rate(spark):
    pieces = [p for t in gen.NEEDLE_TEMPLATES for p in __import__("re").split(r"\{\w+\}", t[1]) if len(p) > 8]
    rows = gen.needle_examples(_ids(spark, 40), 7, num_chunks=5, sentences_per_chunk=5).collect()
    chunks = [c for r in rows for i, c in enumerate(r.context_chunks) if i != r.needle_chunk_idx]
    with_hn = sum(1 for c in chunks if any(p in c for p in pieces))
    rate = with_hn / len(chunks)
    assert 0.10 <= rate <= 0.95


def test_step_curriculum(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (25,), (1000,)], "i long")
    got = [r.c for r in df.select(gen.step_curriculum(F.col("i")).alias("c")).collect()]
    assert got == [3, 4, 5, 8, 20]


def test_linear_curriculum(spark):
    df = spark.createDataFrame([(0,), (50,), (99,), (150,)], "i long")
    got = [r.c for r in df.select(gen.linear_curriculum(F.col("i"), 100, 3, 12).alias("c")).collect()]
    assert got == [3, 7, 11, 12]


def test_lookup_properties(spark):
    rows = gen.lookup_examples(_ids(spark, 10), 42, num_chunks=5, entries_per_chunk=5, key_length=4).collect()
    formats = set()
    for r in rows:
        assert r.template_category == "lookup"
        assert r.num_entries == 25
        assert r.answer in r.context_chunks[r.needle_chunk_idx]
        assert r.needle_text in r.context_chunks[r.needle_chunk_idx]
        assert r.target_key in r.question
        keys = []
        for ch in r.context_chunks:
            for fmt, sep in (("->", " -> "), (":", ": "), ("=", " = ")):
                for part in ch.split(". "):
                    if sep in part and len(part.split(sep)[0]) == 4:
                        keys.append(part.split(sep)[0].strip())
                        formats.add(fmt)
        assert len(set(keys)) == len(keys)
    assert len(formats) >= 2


def test_lookup_keys_unique_by_construction(spark):
    rows = gen.lookup_examples(_ids(spark, 20), 3, num_chunks=5, entries_per_chunk=5, key_length=4,
                               filler_per_chunk=0).collect()
    for r in rows:
        keys = [e.split(" ")[0].rstrip(":") for ch in r.context_chunks for e in ch.split(". ")]
        assert len(keys) == 25 and len(set(keys)) == 25


def test_mixed_schema_superset(spark):
    n = gen.needle_examples(_ids(spark, 3), 1, num_chunks=2)
    lk = gen.lookup_examples(_ids(spark, 3), 101, num_chunks=2)
    assert set(n.columns) <= set(lk.columns)
    mix = gen.mixed_corpus(_ids(spark, 3), 1, needle_kw={"num_chunks": 2}, lookup_kw={"num_chunks": 2})
    assert mix.count() == 6


def test_partition_independence(spark):
    a = gen.needle_examples(_ids(spark, 30).repartition(1), 5, num_chunks=3).orderBy("example_id").collect()
    b = gen.needle_examples(_ids(spark, 30).repartition(7), 5, num_chunks=3).orderBy("example_id").collect()
    assert a == b


def test_category_code(spark):
    df = spark.createDataFrame([("simple",), ("lookup",), ("assertion",), ("unknown",)], "c string")
    got = [r.k for r in df.select(gen.category_code(F.col("c")).alias("k")).collect()]
    assert got == [0, 3, 7, 0]


def test_negative_samples(spark, inputs):
    docs, bench = inputs["documents"], inputs["benchmark"]
    rel = gen.passage_matches(docs, bench).select(F.col("item_id").alias("question_id"), "doc_id")
    qs = bench.select(F.col("item_id").alias("question_id"))
    neg = gen.negative_samples(qs, docs, rel, k=5, seed=1)
    rows = neg.collect()
    per_q = {}
    for r in rows:
        per_q.setdefault(r.question_id, []).append(r.doc_id)
    assert len(per_q) == qs.count()
    relevant = {(r.question_id, r.doc_id) for r in rel.collect()}
    for q, ds in per_q.items():
        assert len(ds) == 5 and len(set(ds)) == 5
        assert not any((q, d) in relevant for d in ds)


def test_passage_matches_brute_force(spark, inputs):
    docs, bench = inputs["documents"], inputs["benchmark"]
    got = {(r.doc_id, r.item_id) for r in gen.passage_matches(docs, bench).collect()}
    d = docs.collect()
    b = bench.collect()
    want = {(x.doc_id, y.item_id) for x in d for y in b if y.text in x.text}
    assert got == want


def test_passage_matches_of_any_length_and_white_space(spark):
    docs = [(1, "one two three four"), (2, "start\nof the line\nhere"), (3, "xtwo wordsy"), (4, "a"), (5, None), (6, "")]
    items = [(1, "two three"), (2, "of the line"), (3, "two words"), (4, "a"), (5, "line\nhere"), (6, " the "), (7, "ne two three f"),
             (8, ""), (9, None), (10, "absent words in none"), (11, "tart\nof the line\nh")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in gen.passage_matches(d, p).collect()}
    assert got == {(x, y) for x, t in docs for y, q in items if t and q and q in t}
    assert gen.passage_matches(d, p.limit(0)).count() == 0


def test_hard_negatives_have_fresh_values(spark):
    d = gen.X("md5(cast(id as string))")
    rows = spark.range(3000).select(gen.col(gen.hard_negative(d)).alias("t"), gen.col(gen.is_hard(d)).alias("hard")).collect()
    assert len({r.t for r in rows}) > 2500 and all(r.t and "{" not in r.t for r in rows)
    assert 0.15 < sum(r.hard for r in rows) / 3000 < 0.25


def test_every_kind_has_a_value(spark):
    assert len(gen.SLOT_KINDS) == 20
    for kind in gen.SLOT_KINDS:
        got = {r.v for r in spark.range(200).select(gen.col(gen.slot_value(kind, gen.X("md5(cast(id as string))"), 1)).alias("v")).collect()}
        assert None not in got and "" not in got and len(got) > 1


def test_generation_is_map_only(spark):
    plan = gen.needle_examples(_ids(spark, 10), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_texts_equal_their_sql(spark):
    """Curricula aside, every generated text is held against SQL over rows, for other sizes than the registered ones."""
    import duckdb

    from corpusflow.plans.corpus_sql import WORDS, lookup_sql, needle_sql

    con = duckdb.connect()
    con.execute("create table documents as select range as doc_id from range(30)")
    for name, sql, df in (("needle", needle_sql(9, 3, 2), gen.needle_examples(_ids(spark, 30), 9, 3, 2)),
                          ("lookup", lookup_sql(9, 2, 7, 3, 5, 1), gen.lookup_examples(_ids(spark, 30), 9, 2, 7, 3, 5, 1))):
        cols = ", ".join(sorted(df.columns))
        want = con.execute(f"with {WORDS}, {sql} select {cols} from {name}").fetchall()
        assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))
