"""Two-stage retrieval queries (RET1-RET10) over the embedding memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import memory as mem
from corpusflow.operators import routing as ret
from corpusflow.plans.registry import register

H, D = 4, 16
FX = ["ret_docs", "ret_queries", "ret_tokens"]


def _r6(c):
    return F.round(c, 6)


def _r6a(c):
    return F.transform(c, lambda x: F.round(x, 6))


def _duck_round(p: str, qtab: str, kv: int = H) -> str:
    rep = H // kv
    return f"""
, {p}_l as (select q.group_id, q.query_id, q.pos, d.doc_id, h.head,
    list_inner_product(q.q[h.head * {D} + 1 : h.head * {D} + {D}],
                       d.key[(h.head // {rep}) * {D} + 1 : (h.head // {rep}) * {D} + {D}]) / 4.0 as logit
    from {qtab} q join ret_docs d using (group_id), (select unnest(range({H})) as head) h)
, {p}_m as (select *, exp(logit - max(logit) over (partition by group_id, query_id, pos, head)) as e from {p}_l)
, {p}_p as (select *, e / sum(e) over (partition by group_id, query_id, pos, head) as p from {p}_m)
, {p}_s as (select group_id, query_id, doc_id, avg(p) as score from {p}_p group by all)
, {p}_x as (select pp.group_id, pp.query_id, pp.pos, pp.head, pp.p,
      unnest(d.value[(pp.head // {rep}) * {D} + 1 : (pp.head // {rep}) * {D} + {D}]) as v,
      generate_subscripts(d.value[(pp.head // {rep}) * {D} + 1 : (pp.head // {rep}) * {D} + {D}], 1) as i
    from {p}_p pp join ret_docs d using (group_id, doc_id))
, {p}_c as (select group_id, query_id, pos, list(s order by head, i) as context from (
    select group_id, query_id, pos, head, i, sum(p * v) as s from {p}_x group by all) y group by all)
"""


def _duck_next(p: str, prev_q: str, ctx: str, w: float) -> str:
    return f"""
, {p} as (select q.group_id, q.query_id, q.pos, list_transform(list_zip(q.q, c.context), lambda z: z[1] + {w} * z[2]) as q
    from {prev_q} q join {ctx} c using (group_id, query_id, pos))
"""


@register("ret_doc_scores", FX, _duck_round("a", "ret_queries") + """
select group_id, query_id, doc_id, round(score, 6) as score from a_s
""")
def q_doc_scores(i):
    """RET1, RET3, RET4: coarse document scores (4 heads x 16 dims)."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    return sc.select("group_id", "query_id", "doc_id", _r6(F.col("score")).alias("score"))


@register("ret_gqa_scores", FX, _duck_round("a", "ret_queries", kv=2) + """
select group_id, query_id, doc_id, round(score, 6) as score from a_s
""")
def q_gqa_scores(i):
    """RET2: grouped heads, 4 query heads over 2 key heads."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D, n_kv_heads=2)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    return sc.select("group_id", "query_id", "doc_id", _r6(F.col("score")).alias("score"))


@register("ret_prob_sums", FX, _duck_round("a", "ret_queries") + """
select query_id, cast(head as int) as head, round(sum(p), 6) as total from a_p group by all
""")
def q_prob_sums(i):
    """RET3 property: probabilities of each query head sum to 1."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D)
    pr = ret.softmax(lg, ["group_id", "query_id", "pos", "head"])
    return pr.groupBy("query_id", "head").agg(_r6(F.sum("p")).alias("total"))


@register("ret_context", FX, _duck_round("a", "ret_queries") + """
select group_id, query_id, pos, list_transform(context, lambda x: round(x, 6)) as context from a_c
""")
def q_context(i):
    """RET5: probability-weighted value vectors, heads concatenated."""
    _, ctx = ret.coarse_round(i["ret_queries"], i["ret_docs"], H, D)
    return ctx.select("group_id", "query_id", "pos", _r6a(F.col("context")).alias("context"))


@register("ret_top_docs", FX, _duck_round("a", "ret_queries") + """
, t as (select *, row_number() over (partition by group_id, query_id order by score desc, doc_id) as rank from a_s)
select group_id, query_id, doc_id, cast(rank as int) as rank,
  round(score / sum(score) over (partition by group_id, query_id), 6) as renorm
from t where rank <= 5
""")
def q_top_docs(i):
    """RET6: top-5 documents per query, scores renormalised."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    top = ret.top_k(sc, 5, ["group_id", "query_id"])
    return top.select("group_id", "query_id", "doc_id", "rank", _r6(F.col("renorm")).alias("renorm"))


_FINE_SQL = _duck_round("a", "ret_queries") + f"""
, top as (select * from (select *, row_number() over (partition by group_id, query_id order by score desc, doc_id) as rk
          from a_s) x where rk <= 5)
, fl as (select q.group_id, q.query_id, q.pos, t.doc_id, t.tok_pos, h.head,
    list_inner_product(q.q[h.head * {D} + 1 : h.head * {D} + {D}], t.key[h.head * {D} + 1 : h.head * {D} + {D}]) / 4.0
      + ln(top.score + 1e-6) as logit
    from ret_queries q join top using (group_id, query_id) join ret_tokens t on t.group_id = top.group_id
      and t.doc_id = top.doc_id, (select unnest(range({H})) as head) h)
, fm as (select *, exp(logit - max(logit) over (partition by group_id, query_id, pos, head)) as e from fl)
, fp as (select *, e / sum(e) over (partition by group_id, query_id, pos, head) as p from fm)
"""


@register("ret_fine_doc_mass", FX, _FINE_SQL + """
select group_id, query_id, doc_id, round(avg(p) * 4, 6) as mass from fp group by all
""")
def q_fine_doc_mass(i):
    """RET7: token attention (with document bias) summed per document,
    tokens restricted to the top-5 documents (RET6 -> RET7)."""
    q, t = i["ret_queries"], i["ret_tokens"]
    lg = ret.coarse_logits(q, i["ret_docs"], H, D)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    top = ret.top_k(sc, 5, ["group_id", "query_id"])
    fl = ret.fine_logits(q, t, top, H, D)
    fp = ret.softmax(fl, ["group_id", "query_id", "pos", "head"])
    return fp.groupBy("group_id", "query_id", "doc_id").agg(_r6(F.avg("p") * 4).alias("mass"))


@register("ret_top_tokens", FX, _FINE_SQL + """
select group_id, query_id, cast(head as int) as head, doc_id, cast(tok_pos as int) as tok_pos, cast(rank as int) as rank from (
  select *, row_number() over (partition by group_id, query_id, pos, head order by p desc, doc_id, tok_pos) as rank
  from fp) x where rank <= 6
""")
def q_top_tokens(i):
    """RET8: the 6 most attended tokens per query head inside the top docs."""
    q, t = i["ret_queries"], i["ret_tokens"]
    lg = ret.coarse_logits(q, i["ret_docs"], H, D)
    sc = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    top = ret.top_k(sc, 5, ["group_id", "query_id"])
    fp = ret.softmax(ret.fine_logits(q, t, top, H, D), ["group_id", "query_id", "pos", "head"])
    tm = ret.top_m_tokens(fp, 6, ["group_id", "query_id", "pos", "head"])
    return tm.select("group_id", "query_id", "head", "doc_id", F.col("tok_pos").cast("int").alias("tok_pos"), "rank")


@register("ret_rounds", FX, _duck_round("r0", "ret_queries") + _duck_next("q1", "ret_queries", "r0_c", 0.5)
          + _duck_round("r1", "q1") + _duck_next("q2", "q1", "r1_c", 0.5) + _duck_round("r2", "q2") + """
select group_id, query_id, doc_id, 0 as round, round(score, 6) as score from r0_s
union all select group_id, query_id, doc_id, 1, round(score, 6) from r1_s
union all select group_id, query_id, doc_id, 2, round(score, 6) from r2_s
""")
def q_rounds(i):
    """RET9: three rounds, each query moved by half its context."""
    out = ret.rounds(i["ret_queries"], i["ret_docs"], 3, 0.5, H, D)
    return out.select("group_id", "query_id", "doc_id", "round", _r6(F.col("score")).alias("score"))


@register("ret_gated_blend", FX, _duck_round("a", "ret_queries") + """
select group_id, query_id, pos, list_transform(list_zip(q.q, c.context),
  lambda z: round(z[1] + (1.0 / (1.0 + exp(-0.3))) * z[2], 6)) as blended
from ret_queries q join a_c c using (group_id, query_id, pos)
""")
def q_gated_blend(i):
    """RET10: base query + sigmoid(0.3) * context."""
    q = i["ret_queries"]
    _, ctx = ret.coarse_round(q, i["ret_docs"], H, D)
    j = q.join(ctx, ["group_id", "query_id", "pos"])
    return j.select("group_id", "query_id", "pos", _r6a(ret.gated_blend(F.col("q"), F.col("context"), 0.3))
                    .alias("blended"))


@register("ret_top_docs_pruned", FX, """
, s as (select q.group_id, q.query_id, q.pos, d.doc_id, list_inner_product(q.q, d.key) / 8.0 as score from ret_queries q join ret_docs d using (group_id))
, t as (select *, row_number() over (partition by group_id, query_id, pos order by score desc, doc_id) as rank from s)
select group_id, query_id, pos, doc_id, cast(rank as int) as rank, round(score, 6) as score,
  round(exp(score) / sum(exp(score)) over (partition by group_id, query_id, pos), 6) as renorm
from t where rank <= 20
""")
def q_top_docs_pruned(i):
    """RET6: top-20 documents by raw score, blocks below the 20-th score left unscored, softmax over the 20."""
    top, _ = ret.pruned_top_k(i["ret_queries"], i["ret_docs"], 20, H * D)
    return top.select("group_id", "query_id", "pos", "doc_id", "rank", _r6(F.col("score")).alias("score"), _r6(F.col("renorm")).alias("renorm"))


_PACK = """
, d as (select group_id, doc_id, key, list_max(list_transform(key, lambda x: abs(x))) / 7.0 as scale from ret_docs)
, k as (select *, list_transform(key, lambda x: cast(round_even(x / case when scale > 0 then scale else 1.0 end, 0) as int)) as code from d)
, u as (select group_id, query_id, q, list_max(list_transform(q, lambda x: abs(x))) / 127.0 as qscale from ret_queries)
, v as (select *, list_transform(q, lambda x: cast(round_even(x / case when qscale > 0 then qscale else 1.0 end, 0) as int)) as qcode from u)
"""


def _packed(i):
    codes, scale, deq = mem.quantize(F.col("key"), bits=4)
    l1 = F.aggregate(deq, F.lit(0.0), lambda a, x: a + F.abs(x))
    return i["ret_docs"].select("group_id", "doc_id", "key", codes.alias("codes"), scale.alias("scale"), l1.alias("l1")).select(
        "group_id", "doc_id", "key", "scale", "l1", mem.pack4(F.col("codes"), H * D).alias("packed"))


@register("mem_pack4", FX, _PACK + """
select doc_id, lower(string_agg(printf('%02x', code[2 * j + 1] + 8 + 16 * (code[2 * j + 2] + 8)), '' order by j)) as packed_hex,
  cast(32 as int) as n_bytes, round(any_value(scale), 9) as scale
from k, (select unnest(range(32)) as j) r group by doc_id
""")
def q_pack4(i):
    """MEM11: 4-bit codes of 64 numbers in 32 bytes."""
    return _packed(i).select("doc_id", F.lower(F.hex("packed")).alias("packed_hex"), F.octet_length("packed").alias("n_bytes"),
                             F.round("scale", 9).alias("scale"))


@register("ret_packed_scores", FX, _PACK + """
select k.group_id, v.query_id, k.doc_id, round(list_inner_product(cast(code as double[]), cast(qcode as double[])) * scale * qscale, 6) as score,
  round(list_inner_product(q, key), 6) as exact, true as within_bound
from k join v using (group_id)
""")
def q_packed_scores(i):
    """MEM11: every document scored from its packed codes, with the exact score and the bound of the error held."""
    codes, scale, _ = mem.quantize(F.col("q"), bits=8)
    q1 = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.abs(x))
    asked = i["ret_queries"].select("group_id", "query_id", "q", codes.alias("codes"), scale.alias("qscale"), q1.alias("q1"))
    got = mem.packed_scores(_packed(i).select("group_id", "doc_id", "packed", "scale", "l1"), asked.drop("q"), H * D)
    exact = i["ret_docs"].select("group_id", "doc_id", "key").join(asked.select("group_id", "query_id", "q"), "group_id").select(
        "group_id", "query_id", "doc_id", ret.dot(F.col("q"), F.col("key")).alias("exact"))
    j = got.join(exact, ["group_id", "query_id", "doc_id"])
    return j.select("group_id", "query_id", "doc_id", _r6(F.col("score")).alias("score"), _r6(F.col("exact")).alias("exact"),
                    (F.abs(F.col("score") - F.col("exact")) <= F.col("bound") + 1e-9).alias("within_bound"))
