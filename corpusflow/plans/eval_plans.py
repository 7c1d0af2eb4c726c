"""Evaluation and telemetry queries (EVL1-EVL9, SNK2, TEL1-TEL9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from functools import reduce

from corpusflow.operators import memory as mem
from corpusflow.operators import routing as ret
from corpusflow.operators import scoring as sc
from corpusflow.operators import telemetry as tel
from corpusflow.operators.corpora import passage_matches
from corpusflow.functions.ordering import seq_number
from corpusflow.operators import retention as rtn
from corpusflow.plans.registry import register
from corpusflow.plans.routing_plans import D, FX, H, _duck_round, _duck_next
from corpusflow.session import checkpoint_dir

METRICS = ["loss", "gate_value", "grad_norm", "learning_rate", "encoder_grad_norm"]

_SCORED = r"""
, n as (select example_id, category, variant, lower(regexp_replace(expected, '^\s+|\s+$', '', 'g')) as e,
          lower(regexp_replace(generated, '^\s+|\s+$', '', 'g')) as g from eval_pred)
, scored as (select example_id, category, variant, (g = e or starts_with(g, e)) as exact, g = e as strict,
    coalesce(length(e) > 0 and regexp_matches(g, '(^|[^\pL\pN_])' || regexp_escape(e) || '([^\pL\pN_]|$)'), false)
      as substring from n)
"""


def _r6(c):
    return F.round(c, 6)


@register("evl_scored", ["eval_pred"], _SCORED + """
select example_id, category, variant, exact, strict, substring from scored
""")
def q_scored(i):
    """EVL1 + EVL2: normalised exact / strict / whole-word matches."""
    return sc.score(i["eval_pred"]).select("example_id", "category", "variant", "exact", "strict", "substring")


_ACC = _SCORED + """
, acc as (select variant, category, count(*) as total,
    coalesce(avg(cast(exact as double)), 0.0) as exact_acc,
    coalesce(avg(cast(substring as double)), 0.0) as substring_acc,
    coalesce(avg(cast(strict as double)), 0.0) as strict_acc
  from scored group by grouping sets ((variant, category), (variant)))
"""


@register("evl_accuracy", ["eval_pred"], _ACC + """
select variant, category, total, round(exact_acc, 6) as exact_acc, round(substring_acc, 6) as substring_acc,
  round(strict_acc, 6) as strict_acc from acc
""")
def q_accuracy(i):
    """EVL3 + EVL4: overall (category NULL) and per-category accuracy per run."""
    a = sc.accuracy(sc.score(i["eval_pred"]), by=["variant"])
    return a.select("variant", "category", "total", _r6(F.col("exact_acc")).alias("exact_acc"),
                    _r6(F.col("substring_acc")).alias("substring_acc"), _r6(F.col("strict_acc")).alias("strict_acc"))


def _answer_length(scored):
    """An evaluation a caller could bring along: answer length and exact rate per category."""
    return scored.groupBy("variant", "category").agg(
        F.avg(F.length("generated")).alias("mean_chars"), F.count_if(F.col("exact")).alias("n_exact"))


@register("udx_evaluation", ["eval_pred"], _SCORED + """
select variant, category, round(avg(length(generated)), 6) as mean_chars, count(*) filter (where exact) as n_exact
from scored join eval_pred using (example_id, category, variant) group by variant, category
""")
def q_evaluation(i):
    """UDX5: a caller's evaluation function over the prediction table."""
    r = sc.evaluate(i["eval_pred"], _answer_length)
    return r.select("variant", "category", _r6(F.col("mean_chars")).alias("mean_chars"), "n_exact")


@register("evl_failures", ["eval_pred"], _SCORED + """
select variant, category, example_id, cast(rank as int) as rank from (
  select *, row_number() over (partition by variant, category order by example_id) as rank
  from scored where not exact) x where rank <= 3
""")
def q_failures(i):
    """EVL5: first three failures per run and category."""
    f = sc.first_failures(sc.score(i["eval_pred"]), 3, by=["variant"])
    return f.select("variant", "category", "example_id", "rank")


@register("evl_memory_delta", ["eval_pred"], _ACC + """
, w as (select * from acc where variant = 'with_memory'), wo as (select * from acc where variant = 'without_memory')
select coalesce(w.category, wo.category) as category,
  round(coalesce(w.exact_acc, 0) - coalesce(wo.exact_acc, 0), 6) as exact_delta,
  round(coalesce(w.substring_acc, 0) - coalesce(wo.substring_acc, 0), 6) as substring_delta
from w full outer join wo on coalesce(w.category, '__all__') = coalesce(wo.category, '__all__')
""")
def q_memory_delta(i):
    """EVL6: with - without memory per category (missing = 0) and overall."""
    d = sc.memory_delta(sc.accuracy(sc.score(i["eval_pred"]), by=["variant"]))
    return d.select("category", _r6(F.col("exact_delta")).alias("exact_delta"),
                    _r6(F.col("substring_delta")).alias("substring_delta"))


@register("evl_paired", ["eval_pred"], _SCORED + """
select a.category, count(*) as paired, count(*) filter (where a.exact and not b.exact) as fixed,
  count(*) filter (where not a.exact and b.exact) as broken
from scored a join scored b on a.example_id = b.example_id and a.variant = 'with_memory' and b.variant = 'without_memory'
group by a.category
""")
def q_paired(i):
    """EVL6 paired on example_id: examples fixed / broken by memory."""
    return sc.paired_delta(sc.score(i["eval_pred"]))


@register("evl_verdict", ["eval_pred", "step_metric"], _ACC + """
, g as (select avg(value) as avg_gate from step_metric where name = 'gate_value')
select round(a.exact_acc, 6) as accuracy, round(g.avg_gate, 6) as avg_gate,
  case when a.exact_acc > 0.5 and abs(g.avg_gate) > 0.1 then 'success'
       when a.exact_acc > 0.1 or abs(g.avg_gate) > 0.05 then 'partial' else 'investigate' end as verdict
from acc a, g where a.variant = 'with_memory' and a.category is null
""")
def q_verdict(i):
    """EVL7: run verdict from overall accuracy and the mean gate value."""
    a = sc.accuracy(sc.score(i["eval_pred"]), by=["variant"]) \
        .filter((F.col("variant") == "with_memory") & F.col("category").isNull())
    g = i["step_metric"].filter(F.col("name") == "gate_value").agg(F.avg("value").alias("avg_gate"))
    j = a.select("exact_acc").unionByName(g, allowMissingColumns=True).agg(
        F.first("exact_acc", ignorenulls=True).alias("exact_acc"), F.first("avg_gate", ignorenulls=True).alias("avg_gate"))
    return j.select(_r6(F.col("exact_acc")).alias("accuracy"), _r6(F.col("avg_gate")).alias("avg_gate"),
                    sc.verdict(F.col("exact_acc"), F.col("avg_gate")).alias("verdict"))


@register("evl_edit_similarity", ["eval_pred"])
def q_edit_similarity(i):
    """EVL8: mean edit similarity of generated to expected per run and category
    (character Levenshtein; checked against Python in pytest)."""
    p = i["eval_pred"]
    s = sc.edit_similarity(sc.normalize(F.col("generated")), sc.normalize(F.col("expected")))
    return p.groupBy("variant", "category").agg(_r6(F.avg(s)).alias("edit_similarity"))


def _passage_ranks(i, chunk_len: int = 64):
    docs, bench = i["documents"], i["benchmark"]
    # three branches read the matches: kept once
    checkpoint_dir(i.spark)
    m = passage_matches(docs, bench).checkpoint(eager=True)
    d = docs.join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    toks = mem.doc_token_rows(d, chunk_len)
    dims = mem.hashed_dims(F.col("token"))
    cvec = toks.groupBy("doc_id", "chunk_idx").agg(*[F.avg(c).alias(f"v{k}") for k, c in enumerate(dims)])
    pw = bench.select("item_id", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("token"))
    qvec = pw.groupBy("item_id").agg(*[F.avg(c).alias(f"q{k}") for k, c in enumerate(dims)])
    score = reduce(lambda a, b: a + b, [F.col(f"v{k}") * F.col(f"q{k}") for k in range(len(dims))])
    scores = m.select("doc_id", "item_id").join(cvec, "doc_id").join(qvec, "item_id").select("doc_id", "item_id", "chunk_idx", score.alias("score"))
    text = docs.select("doc_id", "text")
    needle = m.join(text, "doc_id").select(
        "doc_id", "item_id",
        F.floor(F.size(F.filter(F.split(F.substring(F.col("text"), F.lit(1), F.col("offset") - 1), " "),
                                lambda w: w != "")) / chunk_len).cast("int").alias("needle_chunk"))
    # rank of the needle chunk = 1 + chunks scored higher (ties by chunk
    # index): a conditional count per (document, passage), no window
    target = scores.join(needle, ["doc_id", "item_id"]).filter(F.col("chunk_idx") == F.col("needle_chunk")) \
        .select("doc_id", "item_id", F.col("score").alias("_ns"), "needle_chunk")
    better = (F.col("score") > F.col("_ns")) | ((F.col("score") == F.col("_ns")) & (F.col("chunk_idx") < F.col("needle_chunk")))
    return scores.join(target, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").agg(
        (F.count_if(better) + 1).alias("needle_rank"))


_V = ("list_transform(range(16), lambda d: (('0x' || substr(md5({t}), cast(d * 2 + 1 as int), 2))::INT - 127.5)"
      " / 127.5)")


@register("evl_hit_rate", ["documents", "benchmark"], f"""
with m as (select d.doc_id, b.item_id, instr(d.text, b.text) as pos, d.text
           from documents d join benchmark b on contains(d.text, b.text)),
dw as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as words from documents
       where doc_id in (select doc_id from m)),
t as (select doc_id, unnest(words) as token, generate_subscripts(words, 1) - 1 as p from dw),
tv as (select doc_id, p // 64 as chunk_idx, {_V.format(t='token')} as vec from t),
el as (select doc_id, chunk_idx, unnest(vec) as v, generate_subscripts(vec, 1) as d from tv),
cvec as (select doc_id, chunk_idx, d, avg(v) as v from el group by all),
pw as (select item_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as token from benchmark),
pv as (select item_id, {_V.format(t='token')} as vec from pw),
pel as (select item_id, unnest(vec) as v, generate_subscripts(vec, 1) as d from pv),
qvec as (select item_id, d, avg(v) as qv from pel group by all),
sc as (select m.doc_id, m.item_id, c.chunk_idx, sum(c.v * q.qv) as score
       from m join cvec c on c.doc_id = m.doc_id join qvec q on q.item_id = m.item_id and q.d = c.d group by all),
nd as (select doc_id, item_id,
         len(list_filter(string_split(substr(text, 1, pos - 1), ' '), lambda x: x <> '')) // 64 as needle_chunk from m),
tg as (select s.doc_id, s.item_id, s.score as ns, n.needle_chunk from sc s join nd n using (doc_id, item_id)
       where s.chunk_idx = n.needle_chunk),
rk as (select s.doc_id, s.item_id, count(*) filter (where s.score > g.ns or (s.score = g.ns and s.chunk_idx < g.needle_chunk))
         + 1 as needle_rank from sc s join tg g using (doc_id, item_id) group by all)
select avg(case when needle_rank <= 1 then 1.0 else 0.0 end) as hit_at_1,
  avg(case when needle_rank <= 3 then 1.0 else 0.0 end) as hit_at_3,
  avg(case when needle_rank <= 5 then 1.0 else 0.0 end) as hit_at_5, count(*) as queries from rk
""")
def q_hit_rate(i):
    """EVL9: rank of the passage's chunk among the document's chunks when
    scored with hashed bag-of-words vectors; hit rate at 1 / 3 / 5."""
    return sc.hit_rates(_passage_ranks(i), [1, 3, 5])


@register("snk_eval_report", ["eval_pred"], _ACC + """
, shown as (select variant, category, '{"total":' || total || ',"exact_acc":' || exact_acc || ',"substring_acc":' || substring_acc || '}' as v from acc),
runs as (select variant, '"' || variant || '":{"overall":' || max(v) filter (where category is null) || ',"categories":{' ||
    string_agg('"' || category || '":' || v, ',' order by category) filter (where category is not null) || '}}' as v
  from shown group by variant),
delta as (select coalesce(category, 'overall') as k,
    coalesce(sum(exact_acc) filter (where variant = 'with_memory'), 0.0) - coalesce(sum(exact_acc) filter (where variant = 'without_memory'), 0.0) as e,
    coalesce(sum(substring_acc) filter (where variant = 'with_memory'), 0.0)
      - coalesce(sum(substring_acc) filter (where variant = 'without_memory'), 0.0) as s
  from acc where variant in ('with_memory', 'without_memory') group by category)
select '{"runs":{' || (select string_agg(v, ',' order by variant) from runs) || '},"delta":{' ||
  (select string_agg('"' || k || '":{"exact_delta":' || e || ',"substring_delta":' || s || '}', ',' order by k) from delta) || '}}' as report
""")
def q_eval_report(i):
    """SNK2: one-row JSON evaluation report (runs, categories, deltas)."""
    a = sc.accuracy(sc.score(i["eval_pred"]), by=["variant"])
    return sc.report_json(a, sc.memory_delta(a))


# ------------------------------------------------------------- telemetry

@register("tel_epoch_means", ["step_metric"], """
with s as (select epoch, count(distinct step) as steps from step_metric group by epoch)
select m.epoch, m.name,
  sign(sum(cast(round(m.value * 1e8) as bigint))) * floor((abs(sum(cast(round(m.value * 1e8) as bigint))) * 2
    + max(s.steps) * 100) / (max(s.steps) * 200)) / 1000000.0 as mean_over_steps,
  sign(sum(cast(round(m.value * 1e8) as bigint))) * floor((abs(sum(cast(round(m.value * 1e8) as bigint))) * 2
    + count(m.value) * 100) / (count(m.value) * 200)) / 1000000.0 as mean_over_logged
from step_metric m join s using (epoch) group by m.epoch, m.name
""")
def q_epoch_means(i):
    """TEL1: per-epoch means over all steps and over logged steps."""
    return tel.epoch_means(i["step_metric"], digits=6)


_STEPS = """
, st as (select epoch, step, max(value) filter (where name = 'loss') as loss,
    max(value) filter (where name = 'gate_value') as gate_value, max(value) filter (where name = 'grad_norm') as grad_norm,
    max(value) filter (where name = 'learning_rate') as learning_rate,
    max(value) filter (where name = 'encoder_grad_norm') as encoder_grad_norm
  from step_metric group by epoch, step)
"""


def _steps(i):
    m = i["step_metric"]
    return m.groupBy("epoch", "step").pivot("name", METRICS).agg(F.max("value"))


@register("tel_derived", ["step_metric"], _STEPS + """
select epoch, step, round(exp(least(loss, 20.0)), 6) as perplexity,
  round(encoder_grad_norm / greatest(grad_norm, 1e-8), 6) as grad_ratio from st
""")
def q_derived(i):
    """TEL2: perplexity and gradient ratio per step."""
    d = tel.derived_metrics(_steps(i))
    return d.select("epoch", "step", _r6(F.col("perplexity")).alias("perplexity"),
                    _r6(F.col("grad_ratio")).alias("grad_ratio"))


@register("tel_gate_means", ["step_metric"], """
select epoch, round(avg(round(value * 1e8)) / 1e8, 6) as avg_gate, round(avg(abs(round(value * 1e8))) / 1e8, 6) as avg_abs_gate,
  count(value) as steps
from step_metric where name = 'gate_value' group by epoch
""")
def q_gate_means(i):
    """TEL2: gate averages per epoch."""
    return tel.gate_means(i["step_metric"])


@register("tel_attention_entropy", FX, _duck_round("a", "ret_queries") + """
select query_id, round(avg(h), 6) as entropy from (
  select query_id, pos, head, -sum(p * ln(p + 1e-8)) as h from a_p group by all) x group by query_id
""")
def q_attention_entropy(i):
    """TEL3: attention entropy per query (averaged over heads)."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D)
    pr = ret.softmax(lg, ["group_id", "query_id", "pos", "head"])
    e = tel.entropy(pr, ["query_id", "pos", "head"])
    return e.groupBy("query_id").agg(_r6(F.avg("entropy")).alias("entropy"))


_WEIGHTS = """
with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as words from documents),
t as (select doc_id, unnest(words) as token, generate_subscripts(words, 1) - 1 as pos, len(words) as n from w
      where len(words) > 0),
wt as (select doc_id, pos, (('0x' || substr(md5(token), 1, 4))::INT + 1) / 65536.0 as weight, n from t)
"""


def _weighted(toks, more=()):
    return toks.select(F.col("doc_id").alias("example_id"), *more, "chunk_idx", (F.col("chunk_idx") * 128 + F.col("pos")).alias("pos"),
                       ((F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int") + 1) / 65536.0).alias("weight"))


def _weights(i):
    toks = mem.doc_token_rows(i["documents"], 128)
    weights = _weighted(toks)
    chunks = toks.groupBy(F.col("doc_id").alias("example_id"), "chunk_idx").agg(F.count(F.lit(1)).alias("n_tokens"))
    return weights, chunks


@register("tel_needle_precision", ["documents"], _WEIGHTS + """
, nd as (select doc_id, cast(('0x' || substr(md5(concat_ws(':', '42', cast(doc_id as varchar), 'needle')), 1, 8))::BIGINT
           % cast(ceil(max(n) / 128) as bigint) as int) as nc from wt group by doc_id)
select wt.doc_id as example_id,
  round(sum(case when pos >= nc * 128 and pos < nc * 128 + 128 then weight else 0 end) / sum(weight), 6)
    as needle_precision
from wt join nd using (doc_id) group by wt.doc_id
""")
def q_needle_precision(i):
    """TEL4: attention mass on a hashed needle chunk's token span."""
    from corpusflow.functions.hashrand import X, col, rint
    w, chunks = _weights(i)
    nch = chunks.groupBy("example_id").agg(F.count(F.lit(1)).alias("_n"))
    needles = nch.select("example_id", col(X(f"cast({rint(X('_n'), 42, X('example_id'), 'needle')} as int)"))
                         .alias("needle_chunk_idx"))
    out = tel.chunk_needle_precision(w, needles)
    return out.select("example_id", _r6(F.col("needle_precision")).alias("needle_precision"))


BUDGETS = [200, 100, 50, 25]


@register("evl_token_retention", ["documents"], _WEIGHTS + """
, nd as (select doc_id, cast(('0x' || substr(md5(concat_ws(':', '42', cast(doc_id as varchar), 'needle')), 1, 8))::BIGINT
           % cast(ceil(max(n) / 128) as bigint) as int) as nc from wt group by doc_id)
, tk as (select wt.doc_id, pos // 128 = nc as is_answer, row_number() over (partition by wt.doc_id order by weight desc, pos) as rk
         from wt join nd using (doc_id))
select budget, count(distinct doc_id) as queries, count(*) filter (where is_answer) as answer_tokens,
  count(*) filter (where is_answer and rk <= budget) as kept,
  round(count(*) filter (where is_answer and rk <= budget) / cast(count(*) filter (where is_answer) as double), 6) as share
from tk, (select unnest([200, 100, 50, 25]) as budget) b group by budget
""")
def q_token_retention(i):
    """EVL9: share of the answer chunk's tokens among the 200 / 100 / 50 / 25 heaviest of each document.

    The answer chunk joins the document, not its tokens, and texts are dealt by document: their
    tokens are counted and ranked where they are made."""
    from corpusflow.functions.hashrand import X, col, rint
    docs = i["documents"].select("doc_id", "text").repartition("doc_id")
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    nch = docs.groupBy("doc_id").agg(F.max(F.ceil(words / 128)).alias("_n")).where("_n > 0")
    nc = nch.select("doc_id", col(X(f"cast({rint(X('_n'), 42, X('doc_id'), 'needle')} as int)")).alias("_nc"))
    tokens = _weighted(mem.doc_token_rows(docs.join(nc, "doc_id"), 128, more=("_nc",)), ("_nc",))
    tokens = tokens.withColumn("is_answer", F.col("chunk_idx") == F.col("_nc"))
    out = rtn.retention(tokens, BUDGETS, ["example_id"])
    return out.select(F.col("budget"), "queries", "answer_tokens", "kept", _r6(F.col("share")).alias("share"))


@register("tel_top_concentration", ["documents"], _WEIGHTS + """
select doc_id as example_id, round(sum(weight) filter (where rk <= 5) / sum(weight), 6) as top_concentration from (
  select *, row_number() over (partition by doc_id order by weight desc, pos) as rk from wt) x group by doc_id
""")
def q_top_concentration(i):
    """TEL5: share of attention on the 5 largest weights per document."""
    w, _ = _weights(i)
    out = tel.top_concentration(w, ["example_id"], 5)
    return out.select("example_id", _r6(F.col("top_concentration")).alias("top_concentration"))


@register("tel_routing_loss", FX, _duck_round("a", "ret_queries") + """
, s as (select group_id % 2 as batch, query_id, score,
          row_number() over (partition by group_id order by doc_id) as doc_index from a_s)
, ent as (select batch, query_id, -sum(score * ln(score + 1e-8)) as h from s group by all)
, sp as (select batch, avg(h) as sparsity from ent group by batch)
, nq as (select batch, count(distinct query_id) as nq from s group by batch)
, mn as (select s.batch, doc_index, sum(score) / max(nq.nq) as m from s join nq using (batch) group by all)
, bal as (select batch, sum(m * ln(m + 1e-8)) as balance from mn group by batch)
select batch, round(sparsity, 6) as sparsity, round(balance, 6) as balance,
  round(0.01 * sparsity + 0.01 * balance, 6) as routing_loss from sp join bal using (batch)
""")
def q_routing_loss(i):
    """TEL6: routing sparsity / balance over coarse scores; batches of
    groups by parity, document index = position in its group."""
    lg = ret.coarse_logits(i["ret_queries"], i["ret_docs"], H, D)
    s = ret.doc_scores(ret.softmax(lg, ["group_id", "query_id", "pos", "head"]))
    s = seq_number(s, ["group_id"], [F.col("doc_id")], name="doc_index").withColumn("batch", F.col("group_id") % 2)
    out = tel.routing_losses(s, ["batch"], "doc_index")
    return out.select("batch", _r6(F.col("sparsity")).alias("sparsity"), _r6(F.col("balance")).alias("balance"),
                      _r6(F.col("routing_loss")).alias("routing_loss"))


@register("tel_run_sanity", ["step_metric"], _STEPS + """
select round(arg_min(loss, step) filter (where loss is not null), 6) as first_loss,
  round(arg_max(loss, step) filter (where loss is not null), 6) as last_loss,
  round(avg(grad_norm), 6) as mean_grad_norm,
  arg_max(loss, step) filter (where loss is not null) < arg_min(loss, step) filter (where loss is not null)
    as loss_decreased
from st
""")
def q_run_sanity(i):
    """TEL7: first/last loss, mean gradient norm and pass flags."""
    s = tel.run_sanity(_steps(i))
    return s.select(_r6(F.col("first_loss")).alias("first_loss"), _r6(F.col("last_loss")).alias("last_loss"),
                    _r6(F.col("mean_grad_norm")).alias("mean_grad_norm"), "loss_decreased")


@register("tel_run_checks", ["step_metric"], _STEPS + """
, t as (select step, loss, coalesce(gate_value, 0.0) as g, coalesce(encoder_grad_norm, 0.0) as e from st where loss is not null)
, a as (select arg_min(loss, step) as loss_start, arg_max(loss, step) as loss_end, arg_min(g, step) as gate_start, arg_max(g, step) as gate_end,
  avg(e) as encoder_grad_mean, arg_max(e, step) as last, not bool_or(isnan(loss)) as no_nan from t)
select round(loss_start, 6) as loss_start, round(loss_end, 6) as loss_end, loss_end < loss_start as loss_decreased,
  round(gate_start, 6) as gate_start, round(gate_end, 6) as gate_end, gate_end > gate_start as gate_increased,
  round(encoder_grad_mean, 6) as encoder_grad_mean, last > 0 as encoder_receiving_gradients, no_nan,
  loss_end < loss_start and gate_end > gate_start and last > 0 and no_nan as passed from a
""")
def q_run_checks(i):
    """TEL7: all values and checks of a short run, with the verdict."""
    c = tel.run_checks(_steps(i))
    numbers = ("loss_start", "loss_end", "gate_start", "gate_end", "encoder_grad_mean")
    return c.select(*[_r6(F.col(n)).alias(n) for n in numbers], "loss_decreased", "gate_increased", "encoder_receiving_gradients", "no_nan", "passed")


@register("tel_l2_rollup", ["step_metric"], """
select epoch, name, round(sqrt(sum(value * value)), 6) as l2_norm from step_metric group by epoch, name
""")
def q_l2(i):
    """TEL8: sqrt of summed squares per epoch and metric."""
    out = tel.l2_rollup(i["step_metric"], ["epoch", "name"])
    return out.select("epoch", "name", _r6(F.col("l2_norm")).alias("l2_norm"))


@register("tel_round_diversity", FX, _duck_round("r0", "ret_queries") + _duck_next("q1", "ret_queries", "r0_c", 0.5)
          + _duck_round("r1", "q1") + _duck_next("q2", "q1", "r1_c", 0.5) + _duck_round("r2", "q2") + """
, allr as (select *, 0 as round from r0_s union all select *, 1 from r1_s union all select *, 2 from r2_s)
, t as (select * from (select *, row_number() over (partition by round, group_id, query_id order by score desc, doc_id)
        as rk from allr) x where rk <= 5)
select round, count(distinct (group_id, query_id, doc_id)) as distinct_docs,
  (select count(*) from t p where p.round = t.round - 1 and exists (select 1 from t c where c.round = t.round
     and c.group_id = p.group_id and c.query_id = p.query_id and c.doc_id = p.doc_id)) as overlap_with_previous
from t group by round
""")
def q_round_diversity(i):
    """TEL9: distinct top-5 documents per round and overlap with the previous round."""
    out = ret.rounds(i["ret_queries"], i["ret_docs"], 3, 0.5, H, D)
    top = ret.top_k(out, 5, ["round", "group_id", "query_id"])
    return tel.round_diversity(top, ["group_id", "query_id"])
