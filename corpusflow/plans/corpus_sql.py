"""DuckDB SQL over the whole text of generated corpora (GEN1-GEN6, GEN8, GEN9, GEN12).

The oracles work on rows where the operators work on arrays: one row for each
sentence or entry, joined to tables of templates and put together by ordered
string aggregates.  They share the word lists and templates with the operators,
and the rule that every value is read off an md5 digest.
"""

from __future__ import annotations

from corpusflow.operators import corpora as gen


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(options) -> str:
    return "[" + ", ".join(map(_text, options)) + "]"


def _digest(*parts) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def _h32(n, *parts) -> str:
    return f"(('0x' || substr({_digest(*parts)}, 1, 8))::bigint % {n})"


def _draws(d: str) -> str:
    return ", ".join(f"('0x' || substr({d}, {4 * i + 1}, 4))::int as r{i}" for i in range(8))


def _initcap(s: str) -> str:
    return f"upper(({s})[1]) || substr({s}, 2)"


def _slot(kind: str, at: int) -> str:
    """The value of a kind from draws ``at .. at + 2`` of a row with ``d, r0 .. r7`` beside ``words``."""
    x, y, z = (f"r{at + i}" for i in range(3))
    a, b, c = (f"syllables[{r} % {len(gen.SYLLABLES)} + 1]" for r in (x, y, z))
    abc = f"{a} || {b} || {c}"
    return f"""case {kind}
  when 'badge' then upper(substr(d, {4 * at + 1}, 4) || '-' || substr(d, {4 * at + 5}, 6))
  when 'word' then {abc}
  when 'person' then {_initcap(f"({a} || {b})")} || ' ' || {_initcap(f"({c} || {b} || 'n')")}
  when 'town' then {_initcap(f"({abc})")} || 'by'
  when 'ship' then 'Lady ' || {_initcap(f"({abc})")}
  when 'river' then {_initcap(f"({abc} || 'l')")}
  when 'firm' then {_initcap(f"({a} || {b})")} || ' & ' || {_initcap(f"({c} || {a})")}
  when 'ident' then {a} || {b} || '_' || {c} || ({x} % 97)
  when 'host' then {a} || {b} || '-' || lpad(({z} % 1000)::varchar, 3, '0')
  when 'path' then '/var/' || {a} || {b} || '/' || {c} || '-' || ({x} % 1000) || '.log'
  when 'number' then (2 + {x} % 50000)::varchar
  when 'port' then (1024 + {x} % 64000)::varchar
  when 'day' then strftime(date '1950-01-01' + {x} % 30000, '%-d %B %Y')
  when 'year' then (1700 + {x} % 320)::varchar
  when 'clock' then lpad(({x} % 24)::varchar, 2, '0') || ':' || lpad(({y} % 60)::varchar, 2, '0')
  when 'measure' then (1 + {x} % 400) || '.' || ({y} % 10) || ' kg'
  when 'version' then 'r' || ({x} % 400) || '.' || ({y} % 100)
  when 'craft' then colours[{y} % {len(gen.COLOURS)} + 1] || ' ' || crafts[{x} % {len(gen.CRAFTS)} + 1]
  when 'colour' then colours[{x} % {len(gen.COLOURS)} + 1]
  when 'yesno' then ['Yes', 'No'][{x} % 2 + 1] end"""


def _filled(template: str, slots: dict) -> str:
    for name, value in slots.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


_ID = "cast(doc_id as varchar)"
_FILLERS = gen.FILLER_SLOTS
_TEMPLATES = ",\n  ".join(
    f"({i}, " + ", ".join("null" if v is None else _text(v) for v in t) + ")" for i, t in enumerate(gen.NEEDLE_TEMPLATES))

#: templates and word lists
WORDS = f"""
words as (select {_list(gen.SYLLABLES)} as syllables, {_list(gen.COLOURS)} as colours, {_list(gen.CRAFTS)} as crafts,
  {_list(gen.FILLER_TEMPLATES)} as fillers, {", ".join(f"{_list(o)} as {t}_list" for t, o in _FILLERS)}),
templates(idx, category, statement, ask, reply, kind_a, kind_b) as (values
  {_TEMPLATES})"""


def needle_sql(seed: int, n_chunks: int = 10, per_chunk: int = 5) -> str:
    """CTE ``needle``: all columns of the needle examples of every document."""
    filler = _filled(f"fillers[r0 % {len(gen.FILLER_TEMPLATES)} + 1]", {
        tag: f"{tag}_list[r{i} % {len(opts)} + 1]" for i, (tag, opts) in enumerate(_FILLERS, 1)}
        | {"when": "(1900 + r7 % 125)::varchar"})
    n = len(gen.NEEDLE_TEMPLATES)
    return f"""
needle_draw as (select doc_id, {_h32(n, f"'{seed}'", _ID, "'needle'", "'t'")} as idx,
  {_h32(n_chunks, f"'{seed}'", _ID, "'nc'")} as at_chunk, {_h32(per_chunk + 1, f"'{seed}'", _ID, "'np'")} as at_place,
  {_digest(f"'{seed}'", _ID, "'needle'", "'v'")} as d from documents),
needle_value as (select doc_id, at_chunk, at_place, t.*, {_slot("kind_a", 1)} as va, coalesce({_slot("kind_b", 4)}, '') as vb
  from (select *, {_draws("d")} from needle_draw) x join templates t using (idx), words),
needle_said as (select *, {_filled("statement", {"a": "va", "b": "vb"})} as said, {_filled("ask", {"a": "va", "b": "vb"})} as question,
  {_filled("reply", {"a": "va", "b": "vb"})} as answer from needle_value),
sentence_draw as (select doc_id, chunk, k, {_digest(f"'{seed}'", _ID, "'f'", "chunk", "k")} as d
  from documents, range({n_chunks}) c(chunk), range({per_chunk}) s(k)),
sentence_value as (select doc_id, chunk, k, r7 < {round(gen.HARD_NEGATIVE_RATE * 65536)} as hard, idx, {filler} as filler, statement,
  {_slot("kind_a", 1)} as va, coalesce({_slot("kind_b", 4)}, '') as vb
  from (select *, {_draws("d")} from sentence_draw) x join templates t on t.idx = r0 % {n}, words),
sentence as (select doc_id, chunk, 2 * k + 1 as place,
    case when hard then {_filled("statement", {"a": "va", "b": "vb"})} else filler end as said from sentence_value
  union all select doc_id, at_chunk, 2 * at_place, said from needle_said),
chunk_text as (select doc_id, chunk, string_agg(said, ' ' order by place) as said from sentence group by doc_id, chunk),
needle as (select doc_id as example_id, c.context_chunks, cast(at_chunk as int) as needle_chunk_idx, said as needle_text, question, answer,
    category as template_category, cast(idx as int) as template_idx, {n_chunks} as n_chunks,
    category = 'simple' and exists (select 1 from sentence_value v where v.doc_id = s.doc_id and v.hard and v.idx = s.idx)
      as ambiguous, cast(null as varchar) as target_key, cast(null as int) as num_entries
  from needle_said s join (select doc_id, list(said order by chunk) as context_chunks from chunk_text group by doc_id) c using (doc_id))"""


def lookup_sql(seed: int, n_chunks: int = 5, per_chunk: int = 5, key_length: int = 4, value_length: int = 6, fillers: int = 2) -> str:
    """CTE ``lookup``: all columns of the lookup examples of every document."""
    size, entries, letters = 36 ** key_length, n_chunks * per_chunk, _text(gen.TOKEN_ALPHABET)
    own = f"'{seed}'"
    value = " || ".join(f"substr({letters}, ({_h32(36, own, _ID, _text('val'), 'j', _text(str(q)))} + 1)::int, 1)"
                        for q in range(1, value_length + 1))
    key = ("chunk", "k")

    def drawn(n: int, tag: str) -> str:
        return _h32(n, f"'{seed}'", _ID, "'lf'", *key, _text(tag))

    filler = _filled(f"fillers[{drawn(len(gen.FILLER_TEMPLATES), 't')} + 1]", {
        tag: f"{tag}_list[{drawn(len(opts), tag)} + 1]" for tag, opts in _FILLERS} | {"when": f"(1900 + {drawn(125, 'when')})::varchar"})
    return f"""
entry_parts as (select doc_id, j, {_h32(len(gen.KV_FORMATS), f"'{seed}'", _ID, "'fmt'", "j")} as fmt, {value} as val,
  lower(to_base((({_h32(1 << 30, f"'{seed}'", _ID, "'a'")} * 6 + 1 + 4 * {_h32(2, f"'{seed}'", _ID, "'a2'")}) % {size} * j
    + {_h32(size, f"'{seed}'", _ID, "'b'")}) % {size}, 36, {key_length})) as ent_key
  from documents, range({entries}) e(j)),
entry as (select *, replace(replace({_list(gen.KV_FORMATS)}[fmt + 1], '{{key}}', ent_key), '{{value}}', val) as said from entry_parts),
lookup_line as (select doc_id, j // {per_chunk} as chunk, {_digest(f"'{seed}'", _ID, "'o'", "j")} as o, said from entry
  union all select doc_id, chunk, {_digest(f"'{seed}'", _ID, "'of'", *key)}, {filler}
    from documents, range({n_chunks}) c(chunk), range({fillers}) s(k), words),
lookup_chunk as (select doc_id, chunk, string_agg(said, ' ' order by o, said) as said from lookup_line group by doc_id, chunk),
lookup_all as (select doc_id, list(said order by chunk) as context_chunks from lookup_chunk group by doc_id),
lookup as (select e.doc_id as example_id, context_chunks, cast(j // {per_chunk} as int) as needle_chunk_idx, said as needle_text,
    'Which value is stored under the key ' || ent_key || '?' as question, val as answer, 'lookup' as template_category,
    cast(null as int) as template_idx, {n_chunks} as n_chunks, false as ambiguous, ent_key as target_key, {entries} as num_entries
  from entry e join lookup_all using (doc_id)
  where j = {_h32(entries, f"'{seed}'", "cast(e.doc_id as varchar)", "'target'")})"""
