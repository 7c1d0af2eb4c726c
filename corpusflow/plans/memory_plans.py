"""Document memory queries (MEM1-MEM11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import memory as mem
from corpusflow.plans.registry import register

CHUNK = 128

_VEC = ("list_transform(range(16), lambda d: (('0x' || substr(md5({t}), cast(d * 2 + 1 as int), 2))::INT - 127.5)"
        " / 127.5)")
_CHUNKS_SQL = f"""
with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as words from documents),
c as (select doc_id, unnest(generate_series(0, cast(ceil(len(words) / {CHUNK}) as bigint) - 1)) as chunk_idx, words
      from w where len(words) > 0),
ch as (select doc_id, chunk_idx, words[chunk_idx * {CHUNK} + 1 : chunk_idx * {CHUNK} + {CHUNK}] as tokens from c)
"""


def _chunks(i):
    return mem.chunk_tokens(i["documents"], CHUNK)


@register("mem_chunks", ["documents"], _CHUNKS_SQL + """
select doc_id, chunk_idx, cast(len(tokens) as int) as n_tokens, tokens[1] as first_token, tokens[-1] as last_token from ch
""")
def q_chunks(i):
    """MEM10: 128-token chunks of every document."""
    c = _chunks(i)
    return c.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
                    F.size("tokens").alias("n_tokens"), F.col("tokens")[0].alias("first_token"),
                    F.element_at("tokens", -1).alias("last_token"))


@register("mem_token_table", ["documents"], _CHUNKS_SQL + f"""
, t as (select doc_id, chunk_idx, unnest(tokens) as token from ch)
, v as (select doc_id, chunk_idx, {_VEC.format(t='token')} as vec from t)
select doc_id, chunk_idx, count(*) as n_tokens, round(sum(vec[1]), 6) as sum_dim0, round(sum(vec[16]), 6) as sum_dim15
from v group by doc_id, chunk_idx
""")
def q_token_table(i):
    """MEM6 + MEM7: one row per real token with its hashed vector."""
    t = mem.doc_token_rows(i["documents"], CHUNK).withColumn("vec", mem.hashed_vector(F.col("token")))
    return (t.groupBy("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"))
            .agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum(F.col("vec")[0]), 6).alias("sum_dim0"),
                 F.round(F.sum(F.col("vec")[15]), 6).alias("sum_dim15")))


@register("mem_summaries", ["documents"], _CHUNKS_SQL + f"""
select doc_id, chunk_idx, len(tokens) as n_tokens, {_VEC.format(t='tokens[-1]')} as summary from ch
""")
def q_summaries(i):
    """MEM8: chunk summary = vector of its last real token."""
    t = mem.doc_token_rows(i["documents"], CHUNK)
    s = mem.summaries(t, ["doc_id", "chunk_idx"], encoder=mem.hashed_vector)
    return s.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "n_tokens", "summary")


@register("mem_add", ["memory_entries", "memory_updates"], """
with b as (select * from (select *, row_number() over (partition by doc_id order by version desc) as rn
                          from memory_updates) x where rn = 1)
select doc_id, path, version, n_chars from memory_entries where doc_id not in (select doc_id from b)
union all select doc_id, path, version, n_chars from b
""")
def q_add(i):
    """MEM1: add/replace entries; the newest version in the batch wins."""
    out = mem.add_entries(i["memory_entries"], i["memory_updates"])
    return out.select("doc_id", "path", "version", "n_chars")


@register("mem_get", ["memory_entries", "labels"], """
with ids as (select case when toxic = 1 then doc_id + 1000000 else doc_id end as doc_id from labels)
select ids.doc_id, e.path, e.version from ids left join memory_entries e using (doc_id)
""")
def q_get(i):
    """MEM2: look up labelled ids (toxic ones point at absent entries)."""
    ids = i["labels"].select(F.when(F.col("toxic") == 1, F.col("doc_id") + 1000000)
                             .otherwise(F.col("doc_id")).alias("doc_id"))
    return mem.get_entries(i["memory_entries"], ids).select("doc_id", "path", "version")


@register("mem_remove", ["memory_entries", "labels"], """
select 'remaining' as metric, count(*) as n from memory_entries
where doc_id not in (select doc_id from labels where quality = 0)
union all
select 'found', count(*) from labels l where l.quality = 0 and l.doc_id in (select doc_id from memory_entries)
""")
def q_remove(i):
    """MEM3: remove low-quality documents; rows left and ids found."""
    ids = i["labels"].filter(F.col("quality") == 0).select("doc_id")
    left, found = mem.remove_entries(i["memory_entries"], ids)
    a = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("remaining").alias("metric"), "n")
    b = found.agg(F.count_if(F.col("found")).alias("n")).select(F.lit("found").alias("metric"), "n")
    return a.unionByName(b)


@register("mem_contains", ["memory_entries", "labels"], """
select l.doc_id + l.toxic * 1000000 as doc_id, exists (select 1 from memory_entries e
  where e.doc_id = l.doc_id + l.toxic * 1000000) as contains from labels l
""")
def q_contains(i):
    """MEM4: membership of requested ids."""
    ids = i["labels"].select((F.col("doc_id") + F.col("toxic") * 1000000).alias("doc_id"))
    return mem.size_and_membership(i["memory_entries"], ids)


@register("mem_scope", ["memory_entries"], """
select doc_id, path from memory_entries
where starts_with(path, '/src1') and regexp_full_match(path, '/src1[0-9]/en/.*\\.txt')
""")
def q_scope(i):
    """MEM5: entries under '/src1' matching the glob '/src1?/en/*.txt'."""
    out = mem.by_scope(i["memory_entries"], prefix="/src1", glob="/src1[0-9]/en/*.txt")
    return out.select("doc_id", "path")


@register("mem_refresh", ["documents", "documents_prev"], """
with cur as (select doc_id, sha256(text) as h from documents),
old as (select doc_id, sha256(text) as h from documents_prev)
select 'encode' as action, count(*) as n from cur left join old using (doc_id) where old.h is null or old.h <> cur.h
union all select 'keep', count(*) from cur join old using (doc_id) where old.h = cur.h
union all select 'drop', count(*) from old where doc_id not in (select doc_id from cur)
""")
def q_refresh(i):
    """MEM9: documents to re-encode, keep and drop after a corpus change."""
    prev = i["documents_prev"].select("doc_id", F.sha2("text", 256).alias("content_hash"))
    enc, kept, dropped = mem.refresh_plan(i["documents"], prev)
    return (enc.select(F.lit("encode").alias("action"))
            .unionByName(kept.select(F.lit("keep").alias("action")))
            .unionByName(dropped.select(F.lit("drop").alias("action")))
            .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


@register("mem_quantize", ["embeddings"], """
with s as (select vec_id, cast(embedding as double[]) as e,
  list_max(list_transform(cast(embedding as double[]), lambda x: abs(x))) / 127.0 as scale
           from embeddings),
q as (select vec_id, e, scale, case when scale > 0 then scale else 1.0 end as sf from s),
c as (select vec_id, e, scale, sf, list_transform(e, lambda x: cast(round_even(x / sf, 0) as int)) as codes from q)
select vec_id, codes, round(scale, 9) as scale,
  round(list_max(list_transform(list_zip(e, codes), lambda p: abs(p[1] - p[2] * sf))), 9) as max_err
from c
""")
def q_quantize(i):
    """MEM11: 8-bit codes per embedding with scale and max error."""
    e = i["embeddings"]
    codes, scale, deq = mem.quantize(F.col("embedding"), bits=8)
    mx, _ = mem.quantization_error(F.col("embedding"), deq)
    return e.select("vec_id", codes.alias("codes"), F.round(scale, 9).alias("scale"), F.round(mx, 9).alias("max_err"))


def _md5_vectors(tokens):
    """Python twin of the hashed encoder (one md5 per different token of a batch)."""
    import hashlib

    import numpy as np

    at: dict = {}
    which = [at.setdefault(t, len(at)) for t in tokens]
    digests = b"".join([hashlib.md5(t.encode("utf-8")).digest() for t in at])
    return ((np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)[:, : mem.HASH_DIM] - 127.5) / 127.5)[which]


@register("udx_pandas_encoder", ["documents"], _CHUNKS_SQL + f"""
, t as (select doc_id, chunk_idx, unnest(tokens) as token from ch)
, v as (select doc_id, chunk_idx, {_VEC.format(t='token')} as vec from t)
select doc_id, chunk_idx, count(*) as n_tokens, round(sum(vec[1]), 6) as sum_dim0, round(sum(vec[16]), 6) as sum_dim15
from v group by doc_id, chunk_idx
""")
def q_pandas_encoder(i):
    """UDX3 / MEM6: token vectors from a plugged-in encoder applied to Arrow
    batches with mapInArrow (here the Python twin of the hashed encoder, so
    it must equal MEM6/MEM7)."""
    enc = mem.pandas_encoder(_md5_vectors, mem.HASH_DIM)
    t = enc(mem.doc_token_rows(i["documents"], CHUNK))
    return (t.groupBy("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"))
            .agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum(F.col("vec")[0]), 6).alias("sum_dim0"),
                 F.round(F.sum(F.col("vec")[15]), 6).alias("sum_dim15")))
