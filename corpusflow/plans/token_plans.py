"""Token, padding and batch queries (TOK1-TOK6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import tokens as tok
from corpusflow.plans.registry import register

V = 50000
CHUNK = 512
BATCH = 4

_DIDS = "list_transform(string_split({t}, ' '), lambda w: cast(2 + ('0x' || substr(md5(w), 1, 8))::BIGINT % 49998 as int))"


def _ids(c):
    return tok.hashed_ids(c, V)


def _chunks(ids, n):
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ids) / n).cast("int") - 1, F.lit(0))),
                       lambda c: F.slice(ids, c * n + 1, n))


@register("tok_hashed_ids", ["documents"], f"""
select doc_id, {_DIDS.format(t='text')} as input_ids from documents
""")
def q_hashed_ids(i):
    """TOK1: whole-text hashed token ids."""
    return i["documents"].select("doc_id", _ids(F.col("text")).alias("input_ids"))


@register("tok_pad_chunks", ["documents"], f"""
with d as (select doc_id, {_DIDS.format(t='text')} as ids from documents),
c as (select doc_id, unnest(generate_series(0, cast(ceil(len(ids) / {CHUNK}) as bigint) - 1)) as chunk_idx, ids from d)
select doc_id, chunk_idx, list_concat(ids[chunk_idx * {CHUNK} + 1 : chunk_idx * {CHUNK} + {CHUNK}],
    list_transform(range({CHUNK} - len(ids[chunk_idx * {CHUNK} + 1 : chunk_idx * {CHUNK} + {CHUNK}])), lambda x: 0))
    as input_ids,
  list_concat(list_transform(range(len(ids[chunk_idx * {CHUNK} + 1 : chunk_idx * {CHUNK} + {CHUNK}])), lambda x: 1),
    list_transform(range({CHUNK} - len(ids[chunk_idx * {CHUNK} + 1 : chunk_idx * {CHUNK} + {CHUNK}])), lambda x: 0))
    as attention_mask
from c
""")
def q_pad_chunks(i):
    """TOK2: 512-token chunks padded to 512 with attention masks."""
    d = i["documents"].select("doc_id", _ids(F.col("text")).alias("_ids"))
    c = tok.chunk_rows(d, ["doc_id"], "_ids", CHUNK)
    ids, mask = tok.pad_to(F.col("chunk"), CHUNK)
    return c.select("doc_id", "chunk_idx", ids.alias("input_ids"), mask.alias("attention_mask"))


@register("tok_truncated", ["documents"], f"""
with d as (select doc_id, {_DIDS.format(t='text')} as ids from documents)
select doc_id, len(ids) as n_ids, ids[1 : 256] as cut,
  list_concat(list_transform(range(256 - len(ids[1 : 256])), lambda x: 0), ids[1 : 256]) as left_ids,
  list_concat(ids[1 : 256], list_transform(range(256 - len(ids[1 : 256])), lambda x: 0)) as right_ids
from d
""")
def q_truncated(i):
    """TOK1 + TOK2: a length limit of 256 ids (the feature), padded on either side."""
    d = i["documents"].select("doc_id", _ids(F.col("text")).alias("_ids"))
    d = d.select("doc_id", F.size("_ids").cast("bigint").alias("n_ids"), tok.truncate(F.col("_ids"), 256).alias("cut"))
    return d.select("doc_id", "n_ids", "cut", tok.pad_to(F.col("cut"), 256, left=True)[0].alias("left_ids"),
                    tok.pad_to(F.col("cut"), 256)[0].alias("right_ids"))


@register("tok_vocab", ["documents"], """
with c as (select w as token, count(*) as n from (select unnest(string_split(text, ' ')) as w from documents) x group by w)
select token, cast(row_number() over (order by n desc, token) + 1 as int) as id, n from c
""")
def q_vocab(i):
    """TOK1 vocabulary: whitespace tokens ranked by frequency."""
    return tok.build_vocab(i["documents"])


@register("tok_vocab_ids", ["documents"], """
with c as (select w as token, count(*) as n from (select unnest(string_split(text, ' ')) as w from documents) x group by w),
v as (select token, cast(row_number() over (order by n desc, token) + 1 as int) as id from c),
t as (select doc_id, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) as pos
      from documents)
select t.doc_id, list(v.id order by t.pos) as input_ids from t join v using (token) group by t.doc_id
""")
def q_vocab_ids(i):
    """TOK1 with a vocabulary join (ids re-assembled in position order)."""
    d = i["documents"]
    return tok.vocab_ids(d, tok.build_vocab(d))


def _examples(i):
    # ids are materialised before chunking: the chunk lambda must slice a
    # column, not re-evaluate the tokenizer expression once per chunk
    d = i["documents"].select(
        "doc_id", _ids(F.col("text")).alias("_ids"),
        _ids(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("question_ids"),
        _ids(F.element_at(F.split(F.col("text"), "\n"), -1)).alias("answer_ids"))
    return d.select("doc_id", _chunks(F.col("_ids"), CHUNK).alias("context_ids"), "question_ids", "answer_ids")


_EX_SQL = f"""
with e as (select doc_id, {_DIDS.format(t='text')} as ids,
    {_DIDS.format(t="split_part(text, chr(10), 1)")} as q,
    {_DIDS.format(t="string_split(text, chr(10))[-1]")} as a from documents),
b as (select *, (row_number() over (order by doc_id) - 1) // {BATCH} as batch_id,
        cast(ceil(len(ids) / {CHUNK}) as bigint) as n_chunks,
        least(len(ids), {CHUNK}) as first_len from e),
m as (select *, max(n_chunks) over (partition by batch_id) as cmax, max(len(q)) over (partition by batch_id) as qmax,
        max(len(a)) over (partition by batch_id) as amax, max(first_len) over (partition by batch_id) as lmax from b)
"""


@register("tok_batches", ["documents"], _EX_SQL + """
select doc_id, batch_id, cast(cmax as int) as n_chunks, cast(lmax as int) as chunk_len, cast(qmax as int) as question_len,
  cast(amax as int) as answer_len, cast(len(ids) as int) as context_tokens,
  case when len(q) < qmax then 0 else 1 end as question_first_mask
from m
""")
def q_batches(i):
    """TOK3 + TOK4: batches of 4, questions left-padded, chunks padded."""
    ex = tok.assign_batches(_examples(i), BATCH, [F.col("doc_id")], key=["doc_id"])
    col = tok.collate(ex, ["batch_id"], question_side="left")
    return col.select(
        "doc_id", "batch_id",
        F.size("context_input_ids").alias("n_chunks"),
        F.size(F.col("context_input_ids")[0]).alias("chunk_len"),
        F.size("question_input_ids").alias("question_len"),
        F.size("answer_input_ids").alias("answer_len"),
        F.aggregate(F.flatten("context_attention_mask"), F.lit(0), lambda a, x: a + x).alias("context_tokens"),
        F.col("question_mask")[0].alias("question_first_mask"))


@register("tok_batch_arrays", ["documents"], _EX_SQL + f"""
, k as (select *, list_transform(range(cast(cmax as bigint)), lambda c: ids[c * {CHUNK} + 1 : c * {CHUNK} + {CHUNK}]) as ch from m)
select doc_id, batch_id,
  list_transform(ch, lambda c: list_resize(c, lmax, 0)) as context_input_ids,
  list_transform(ch, lambda c: list_resize(list_transform(c, lambda x: 1), lmax, 0)) as context_attention_mask,
  list_concat(q, list_resize(cast([] as int[]), qmax - len(q), 0)) as question_input_ids,
  list_concat(list_transform(q, lambda x: 1), list_resize(cast([] as int[]), qmax - len(q), 0)) as question_mask,
  list_resize(a, amax, 0) as answer_input_ids, list_resize(list_transform(a, lambda x: 1), amax, 0) as answer_mask
from k
""")
def q_batch_arrays(i):
    """TOK3 + TOK4: the whole padded arrays and masks, questions padded on the right."""
    ex = tok.assign_batches(_examples(i), BATCH, [F.col("doc_id")], key=["doc_id"])
    col = tok.collate(ex, ["batch_id"], question_side="right")
    return col.select("doc_id", "batch_id", "context_input_ids", "context_attention_mask", "question_input_ids",
                      "question_mask", "answer_input_ids", "answer_mask")


@register("tok_teacher_forcing", ["documents"], _EX_SQL + """
select doc_id, cast(len(q) + amax as int) as n_input, cast(len(q) + (amax - len(a)) as int) as n_ignored,
  cast(list_sum(a) as bigint) as label_sum from m
""")
def q_teacher_forcing(i):
    """TOK5: inputs = question ++ padded answer; labels ignore the question
    and the answer padding."""
    ex = tok.assign_batches(_examples(i), BATCH, [F.col("doc_id")], key=["doc_id"])
    col = tok.collate(ex, ["batch_id"], question_side="left")
    q = F.col("question_ids")
    ids, labels = tok.teacher_forcing(q, F.col("answer_input_ids"), F.col("answer_mask"))
    lab = F.filter(labels, lambda x: x != tok.IGNORE_INDEX)
    return col.select("doc_id", F.size(ids).alias("n_input"),
                      F.size(F.filter(labels, lambda x: x == tok.IGNORE_INDEX)).alias("n_ignored"),
                      F.aggregate(lab, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"))


@register("tok_shifted_loss", ["documents"], _EX_SQL + """
, r as (select doc_id, unnest(list_concat(list_transform(q, lambda x: -100), a)) as label,
          unnest(list_concat(q, a)) as tok_id, generate_subscripts(list_concat(q, a), 1) as pos from m),
s as (select *, lead(label) over (partition by doc_id order by pos) as nxt from r)
select doc_id, round(avg(ln(1 + (tok_id % 97) / 97.0)), 6) as loss, count(*) as n_tokens
from s where nxt is not null and nxt <> -100 group by doc_id
""")
def q_shifted_loss(i):
    """TOK6: masked mean NLL with the one-position shift, over a stand-in
    per-position log-probability derived from the input token."""
    ex = _examples(i)
    ids, labels = tok.teacher_forcing(F.col("question_ids"), F.col("answer_ids"))
    rows = ex.select("doc_id", F.posexplode(F.arrays_zip(ids.alias("tok_id"), labels.alias("label"))).alias("pos", "z")) \
        .select("doc_id", "pos", F.col("z.tok_id").alias("tok_id"), F.col("z.label").alias("label"),
                (-F.log(1 + F.pmod(F.col("z.tok_id"), F.lit(97)) / 97.0)).alias("logp"))
    out = tok.shifted_loss(rows, ["doc_id"])
    return out.select("doc_id", F.round("loss", 6).alias("loss"), "n_tokens")


def _md5_word_ids(text: str) -> list[int]:
    import hashlib

    return [2 + int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % (V - 2) for w in text.split(" ")]


@register("udx_pandas_tokenizer", ["documents"], f"""
select doc_id, {_DIDS.format(t='text')} as input_ids from documents
""")
def q_pandas_tokenizer(i):
    """UDX3: a plain Python tokenizer plugged in as an Arrow-batched pandas
    UDF (here the same hashed-word rule, so it must equal TOK1)."""
    t = tok.pandas_tokenizer(_md5_word_ids)
    return i["documents"].select("doc_id", t(F.col("text")).alias("input_ids"))
