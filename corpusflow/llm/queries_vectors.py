"""Registered queries of the vector and spelling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import spelling, vptree, whitening
from corpusflow.llm.common import table
from corpusflow.llm.registry import query

NEIGHBOURS = 20


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened, a row for each component."""
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = model.explained.tolist() if model else []
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"),
                    F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
                    F.get(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("at")).alias("explained"),
                    F.lit(model.identity_error if model else None).cast("double").alias("identity_error")))


OP12_SQL = """
with v as (
  select distinct vec_id, embedding::double[] e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s)
select query_id, r::int rank, vec_id, score from r where r <= 20
"""


@query("op12_vantage_point_search", OP12_SQL)
def op12_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every embedding whose id 20 divides."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), NEIGHBOURS)


OP13_SQL = r"""
with r as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]{7,}')) w from documents),
p as (select doc_id, w, count(*) c from r group by all),
b as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) x from p),
-- crc32 a bit at a time: bits of a byte from the least one on
h as (
  select w, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2 * 8),
      lambda i: ((('0x' || substr(x, 2 * (i // 8) + 1, 2))::bigint >> (i % 8)::int) & 1)::bigint)),
    lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1)))) h from b),
o as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, c from h),
v as materialized (select word, sum(c)::bigint n from o where length(word) >= 7 group by word having sum(c) >= 2),
d as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) less from (select word, unnest(range(1, length(word) + 1)) i from v)),
pairs as (
  select a.word a, b.word b from d a join d b on a.i = b.i and a.less = b.less and a.word <> b.word
  union select d.word, v.word from d join v on d.less = v.word
  union select v.word, d.word from d join v on d.less = v.word),
best as (
  select a, count(*) n_near, first(b order by m desc, b) b, max(m) m
  from (select pairs.a, pairs.b, v.n m from pairs join v on v.word = pairs.b) group by a),
f as materialized (
  select word, n, coalesce(n_near, 0)::bigint n_near, if(m >= 10 * n, b, null) form, if(m >= 10 * n, m, null) form_n
  from v left join best on best.a = v.word),
roots as (
  with recursive t as (
    select word, word last from f
    union all
    select t.word, f.form from t join f on f.word = t.last where f.form is not null)
  select t.word, t.last root from t join f on f.word = t.last where f.form is null)
select word, form, root, n, n_near, form_n from f join roots using (word)
"""


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    words = spelling.misspelt(spelling.occurrences(table(spark, sf_dir, "documents")))
    return spelling.group_variants(spelling.vocabulary(words))
