"""Corpus generation queries (GEN1-GEN14).

Examples are driven by the ``documents`` table (one example per document)
so the generated volume grows with the input.  The SQL over whole generated
texts is made by :mod:`corpusflow.plans.corpus_sql`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import corpora as gen
from corpusflow.plans.corpus_sql import WORDS, lookup_sql, needle_sql
from corpusflow.plans.registry import register

SEED = 42


def _ids(i):
    return i["documents"].select(F.col("doc_id").alias("example_id"))


def _duck_h(*parts: str) -> str:
    inner = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT"


_ID = "cast(doc_id as varchar)"
_CATS = "[" + ", ".join(f"'{c[0]}'" for c in gen.NEEDLE_TEMPLATES) + "]"
_CATNAMES = "[" + ", ".join(f"'{c}'" for c in gen.CATEGORY_NAMES) + "]"


@register("gen_needle_corpus", ["documents"], f"with {WORDS}, {needle_sql(SEED)} select * from needle")
def q_needle_corpus(i):
    """GEN1-GEN6: needle-in-haystack examples (10 chunks x 5 sentences)."""
    return gen.needle_examples(_ids(i), SEED, num_chunks=10, sentences_per_chunk=5)


@register("gen_needle_structure", ["documents"], f"""
with s as (select doc_id as example_id, cast(least(3 + floor(doc_id / 5), 20) as int) as n_chunks,
    cast({_duck_h("'42'", _ID, "'needle'", "'t'")} % 24 as int) as template_idx from documents)
select example_id, n_chunks, template_idx, {_CATS}[template_idx + 1] as template_category,
  cast({_duck_h("'42'", "cast(example_id as varchar)", "'nc'")} % n_chunks as int) as needle_chunk_idx
from s
""")
def q_needle_structure(i):
    """GEN4/GEN6/GEN7: needle placement under the step curriculum."""
    ex = gen.needle_examples(_ids(i), SEED, num_chunks=gen.step_curriculum(F.col("example_id")),
                             sentences_per_chunk=3)
    return ex.select("example_id", "n_chunks", "template_idx", "template_category", "needle_chunk_idx")


@register("gen_lookup_corpus", ["documents"], f"with {WORDS}, {lookup_sql(SEED + 100)} select * from lookup")
def q_lookup_corpus(i):
    """GEN8: key-value lookup examples (5 chunks x 5 entries, key length 4)."""
    return gen.lookup_examples(_ids(i), SEED + 100, num_chunks=5, entries_per_chunk=5, key_length=4)


@register("gen_lookup_structure", ["documents"], f"""
select doc_id as example_id, 25 as num_entries,
  cast(floor(({_duck_h("'142'", _ID, "'target'")} % 25) / 5) as int) as needle_chunk_idx
from documents
""")
def q_lookup_structure(i):
    """GEN8: entry count and target chunk of each lookup example."""
    ex = gen.lookup_examples(_ids(i), SEED + 100, num_chunks=5, entries_per_chunk=5, key_length=4)
    return ex.select("example_id", "num_entries", "needle_chunk_idx")


@register("gen_mixed_corpus", ["documents"], f"""with {WORDS}, {needle_sql(SEED)}, {lookup_sql(SEED + 100)}
select *, 'needle' as task from needle union all select *, 'lookup' as task from lookup""")
def q_mixed(i):
    """GEN9: needle half (seed 42) and lookup half (seed 142)."""
    return gen.mixed_corpus(_ids(i), SEED)


@register("gen_splits", ["documents"], """
with n as (select count(*) as total from documents),
cur as (select doc_id, cast(3 + floor(least(doc_id / n.total, 1.0) * 9) as int) as c from documents, n)
select split, task, count(*) as examples, cast(sum(c) as bigint) as chunks from (
  select 'train' as split, 'needle' as task, c from cur
  union all select 'train', 'lookup', c from cur
  union all select 'eval', 'needle', 12 from cur
  union all select 'eval', 'lookup', 12 from cur) t group by split, task
""")
def q_splits(i):
    """GEN10: train (linear curriculum 3..12) and eval (12 chunks) sets."""
    ids = _ids(i)
    total = ids.count()
    sets = gen.train_eval_sets(ids, SEED, total, lo=3, hi=12, eval_chunks=12)
    return sets.groupBy("split", "task").agg(F.count(F.lit(1)).alias("examples"),
                                             F.sum("n_chunks").cast("bigint").alias("chunks"))


@register("gen_category_codes", ["documents"], f"""
with s as (select doc_id, {_CATS}[cast({_duck_h("'42'", _ID, "'needle'", "'t'")} % 24 as int) + 1] as cat
           from documents)
select cat as template_category, cast(list_position({_CATNAMES}, cat) - 1 as int) as category_code,
  count(*) as examples
from s group by cat
union all select 'lookup', 3, count(*) from documents
""")
def q_category_codes(i):
    """GEN11: category codes of the mixed corpus."""
    mix = gen.mixed_corpus(_ids(i), SEED, needle_kw={"num_chunks": 2}, lookup_kw={"num_chunks": 2})
    return (mix.groupBy("template_category")
            .agg(F.count(F.lit(1)).alias("examples"))
            .withColumn("category_code", gen.category_code(F.col("template_category"))))


@register("gen_prompts", ["documents"], f"""with {WORDS}, {needle_sql(SEED, 4)}, {lookup_sql(SEED + 100, 4)}
select example_id, task, 'Question: ' || question || chr(10) || 'Answer:' as prompt, ' ' || answer as target from (
  select example_id, 'needle' as task, question, answer from needle
  union all select example_id, 'lookup', question, answer from lookup) x""")
def q_prompts(i):
    """GEN12: prompt / target text of the mixed corpus."""
    mix = gen.mixed_corpus(_ids(i), SEED, needle_kw={"num_chunks": 4}, lookup_kw={"num_chunks": 4})
    return gen.prompt_format(mix).select("example_id", "task", "prompt", "target")


@register("gen_real_passages", ["documents", "benchmark"], """
with m as (select d.doc_id, b.item_id, instr(d.text, b.text) as pos, d.text, b.text as passage
           from documents d join benchmark b on contains(d.text, b.text))
select doc_id as example_id, item_id, passage as needle_text,
  cast(floor((len(string_split(substr(text, 1, pos - 1), ' ')) - 1) / 64) as int) as needle_chunk_idx
from m
""")
def q_real_passages(i):
    """GEN13: documents holding a benchmark passage become Q&A examples."""
    ex = gen.real_passage_examples(i["documents"], i["benchmark"], words_per_chunk=64)
    return ex.select("example_id", "item_id", "needle_text", "needle_chunk_idx")


@register("gen_planted", ["documents"], f"""
select doc_id as example_id,
  cast({_duck_h("'42'", _ID, "'plant_pos'")} % greatest(cast(ceil(len(string_split(text, ' ')) / 64) as bigint), 1)
       as int) as needle_chunk_idx,
  {_CATS}[cast({_duck_h("'42'", _ID, "'plant'", "'t'")} % 24 as int) + 1] as template_category
from documents
""")
def q_planted(i):
    """GEN13: generated facts planted into real document chunks."""
    ex = gen.plant_facts(i["documents"], SEED, words_per_chunk=64)
    return ex.select("example_id", "needle_chunk_idx", "template_category")


@register("gen_negatives", ["documents", "benchmark"], f"""
with docs as (select doc_id, row_number() over (order by doc_id) as didx from documents),
nn as (select count(*) as n from documents),
rel as (select distinct b.item_id as question_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text)),
rc as (select question_id, count(*) as r from rel group by all),
q as (select b.item_id as question_id, coalesce(rc.r, 0) as r from benchmark b left join rc on rc.question_id = b.item_id),
c as (select q.question_id, unnest(range(least(q.r + 5, nn.n))) as j,
        {_duck_h("'42'", "cast(q.question_id as varchar)", "'neg'")} % nn.n as start,
        2305843009213693951 % nn.n as step, nn.n as n from q, nn),
cd as (select c.question_id, c.j, docs.doc_id from c join docs on docs.didx = (c.start + c.j * c.step) % c.n + 1),
keep as (select * from cd where not exists (select 1 from rel where rel.question_id = cd.question_id
                                            and rel.doc_id = cd.doc_id))
select question_id, doc_id, cast(rank as int) as rank from (
  select *, row_number() over (partition by question_id order by j) as rank from keep) x where rank <= 5
""")
def q_negatives(i):
    """GEN14: 5 documents without the passage for every benchmark item."""
    rel = gen.passage_matches(i["documents"], i["benchmark"]).select(
        F.col("item_id").alias("question_id"), "doc_id")
    qs = i["benchmark"].select(F.col("item_id").alias("question_id"))
    return gen.negative_samples(qs, i["documents"], rel, k=5, seed=SEED)
