"""Registered queries of the operators built from DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import chat, leaks, mixing, quality
from corpusflow.llm.common import table
from corpusflow.llm.registry import query

OP2_SQL = r"""
with d as (
  select row_number() over () rid, doc_id, coalesce(text, '') t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w
  from documents),
g as (select rid, i, list_slice(w, i, i + 4) gram
      from (select rid, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
again as (select rid, i from g qualify count(*) over (partition by rid, gram) > 1),
cover as (select rid, count(distinct i + j) n from again, (select unnest(range(5)) j) group by rid),
m as (
  select d.*, len(w) n_words, coalesce(cover.n, 0) n_repeat_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
    len(regexp_extract_all(t, '[!?]')) n_marks,
    len(list_filter(w, lambda x: x in (__STOP__))) n_stop,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from d left join cover using (rid)),
r as (
  select *, len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '\| *$'))) n_bars,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
  n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.5 and 12 and n_symbols / n_words <= 0.1
    and n_marks / n_words <= 0.5 and n_stop / n_words >= 0.01
    and n_dup_lines / n_lines <= 0.3 and n_bars / n_lines <= 0.5 kept
from r
""".replace("__STOP__", ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS))))


@query("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
with d as (
  select row_number() over () rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') w from documents),
b as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark),
bw as (
  select distinct item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') win
  from (select item_id, w, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
lens as (select distinct l from bw),
dw as (
  select rid, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') win
  from (select rid, w, l, unnest(range(1, len(w) - l + 2)) i from d, lens where len(w) >= l)),
hits as (select rid, l, i, win from dw semi join bw using (l, win)),
cover as (select rid, count(distinct i + j) n from hits, (select unnest(range(10)) j) where j < l group by rid),
found as (
  select rid, count(distinct item_id) n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids
  from hits join bw using (l, win) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(cover.n, 0)::bigint n_hit, coalesce(found.n, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(cover.n, 0) > 0 contaminated
from d left join cover using (rid) left join found using (rid)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of a benchmark item."""
    marked = leaks.mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(regexp_replace(replace(x, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\]|SEP\]|IMAGE\]|AUDIO\]|DOCUMENT\])', '\1\3\\\2\4', 'g')) c from t)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(3 + length(r) + 5 + c + 4 + if(r = 'assistant', 0, 13))::bigint formatted_chars
from e group by conv_id
"""


@query("op10_chat_format", OP10_SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted strings."""
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    back = chat.parse_conversations(formatted)
    lost = F.array_join(F.filter("parsed", lambda p: p["loss"])["text"], "")
    whole = F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


OP4_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) tok,
    concat_ws('|', coalesce(doc_id::varchar, '~'), md5(coalesce(text, ''))) id, coalesce(source, '~') s
  from documents),
tot as materialized (select source, s, sum(tok)::bigint total from d where tok > 0 group by 1, 2),
p as materialized (select s, total, total / (select sum(total) from tot) p, (select sum(total) from tot)::bigint budget,
  (select count(*) from tot) n from tot),
ent as (  -- bisection for the entropy
  select 0 i, 0.0::double lo, 1.0::double hi
  union all
  select i + 1, if(e >= 0.95 - 1e-9, mid, lo), if(e >= 0.95 - 1e-9, hi, mid)
  from (select i, lo, hi, mid, (ln(z) - ql / z) / ln(n) e
        from (select i, lo, hi, (lo + hi) / 2 mid, any_value(n) n, sum(pow(p, (lo + hi) / 2)) z,
                sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) ql
              from ent, p where i < 24 group by i, lo, hi))),
plain as (select case when any_value(n) < 2 then 1 else -sum(p * ln(p)) / ln(any_value(n)) end e from p),
a1 as (select if(e >= 0.95 - 1e-9, 1.0, (select lo from ent where i = 24)) a from plain),
rep as (  -- bisection for the repeats
  select 0 i, 0.0::double lo, 1.0::double hi
  union all
  select i + 1, if(r <= 2 + 1e-9, lo, mid), if(r <= 2 + 1e-9, mid, hi)
  from (select i, lo, hi, (lo + hi) / 2 mid,
          max(pow(p, (lo + hi) / 2) / total) / sum(pow(p, (lo + hi) / 2)) * any_value(budget) r
        from rep, p where i < 24 group by i, lo, hi)),
at1 as (select max(pow(p, a) / total) / sum(pow(p, a)) * any_value(budget) r, any_value(a) a from p, a1),
alpha as (select round(if(r > 2 + 1e-9, greatest(a, (select hi from rep where i = 24)), a), 6) a from at1),
w as (select s, total, budget, round(pow(p, a) / (select sum(pow(p, a)) from p, alpha), 9) weight from p, alpha),
g as (select *, floor(weight * budget)::bigint goal, greatest(ceil(total / 100000), 1)::bigint nb from w),
k as (select *, unnest(range(0, (goal - 1) // total + 1)) k from g where goal > 0),
plan as (select s, weight, nb, k + 1 pass, least(total, goal - k * total)::bigint "left" from k),
x as (
  select d.doc_id, d.source, d.tok, d.id, plan.*,
    ('0x' || substr(md5(concat_ws('|', '1', d.s, pass, d.id, 'block')), 1, 15))::bigint % nb block,
    ('0x' || substr(md5(concat_ws('|', '1', d.s, pass, d.id, 'order')), 1, 15))::bigint drw
  from d join plan using (s) where tok > 0),
bs as (select s, pass, block, any_value("left") l, sum(tok) size from x group by 1, 2, 3),
bb as (select *, l - coalesce(sum(size) over (partition by s, pass order by block rows between unbounded preceding and 1 preceding), 0) room from bs),
y as (select x.*, bb.size, bb.room from x join bb using (s, pass, block) where room > 0),
z as (select *, coalesce(sum(tok) over (partition by s, pass, block order by drw, id rows between unbounded preceding and 1 preceding), 0) run from y)
select doc_id, source, pass::bigint pass, block::bigint block, tok::bigint n_tokens, weight from z where size <= room or run < room
"""


@query("op4_source_mixing", OP4_SQL)
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: one row for each copy that is taken."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.col("_pass").cast("bigint").alias("pass"), F.col("_block").alias("block"),
        F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"))
