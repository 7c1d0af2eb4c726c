"""Tokenizer operators against the library's encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from awkward import documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusflow.llm import encoding, token_counts, token_files
from corpusflow.llm.common import shared_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from(list("ab'sT.,! 0\n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　é́İßﬁ你!?<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_pieces_encode_as_the_whole(text):
    known = encoding.counter(BYTES)
    assert "".join(encoding.pieces(text)) == text
    assert known.counts([text])[0] == len(known.tok.encode(text, add_special_tokens=False).ids)
    known = encoding.word_encoder(WORDS)
    assert next(known.ids([text])).tolist() == known.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|>\n\n b", "x<|endoftext|><|endoftext|> ", "<|startoftext|>a"])
def test_special_strings_stay_whole(text):
    known = encoding.counter(BYTES)
    assert known.counts([text])[0] == len(known.tok.encode(text, add_special_tokens=False).ids)
    known = encoding.word_encoder(WORDS)
    assert next(known.ids([text])).tolist() == known.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_all_texts_of_a_table(spark, table):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    for text in [r[0] for r in df.select("text" if table == "documents" else "html").collect()]:
        known = encoding.counter(BYTES)
        assert known.counts([text])[0] == len(known.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        known = encoding.word_encoder(WORDS)
        assert next(known.ids([text])).tolist() == known.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "PIECES", 200)
    known = encoding.Words(WORDS)
    for seed in range(20):
        text = prose(seed, 30)
        assert next(known.ids([text])).tolist() == known.tok.encode(text, add_special_tokens=False).ids
        assert len(known.known) <= 200


SIGNED = st.text(st.sampled_from(list("abé'sT.,!?;:#$%&*+-/=@^_~()[]{}\"\\<|> \n\xa0")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNED | st.none(), max_size=5))
def test_runs_of_signs_and_whole_columns(texts):
    known = encoding.word_encoder(WORDS)
    whole = [t or "" for t in texts]
    want = [known.tok.encode(t, add_special_tokens=False).ids for t in whole]
    column = pa.array(["cut off", *whole], pa.string()).slice(1)
    assert [x.tolist() for x in known.ids(column)] == want
    counted = encoding.counter(BYTES)
    assert counted.counts(whole) == [len(counted.tok.encode(t, add_special_tokens=False).ids) for t in whole]


def test_a_word_goes_to_the_model_once_for_all_texts_of_a_block(monkeypatch):
    monkeypatch.setattr(encoding, "PIECES", 0)  # nothing is remembered from block to block
    known, asked = encoding.Words(WORDS), []
    plain = known.plain
    monkeypatch.setattr(known, "plain", lambda p: asked.append(p) or plain(p))
    texts = [f"alpha beta.%%% {'gamma' * (i % 3)}" for i in range(300)]
    want = [known.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in known.ids(texts)] == want
    assert len(asked) == len(set(asked)) and "beta" in asked


def test_token_counts_and_the_cache(spark):
    tok = Tokenizer.from_file(BYTES)
    cache = shared_path(spark, "test-counts")
    want = sorted(((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=str)
    for _ in range(2):
        got = token_counts.count_tokens(documents(spark), cache, BYTES).collect()
        assert sorted(map(tuple, got), key=str) == want
        stored = token_counts.read_cache(spark, cache)
        assert stored.count() == len({r[1] or "" for r in rows()})  # one for each digest, none twice
    # a stored count is used, and another version of the tokenizer is not
    token_counts.count_tokens(empty(spark), cache, BYTES).collect()
    token_counts.count_tokens(documents(spark), cache, WORDS).collect()
    assert token_counts.read_cache(spark, cache).select("version").distinct().count() == 2
    assert sorted(map(tuple, token_counts.count_tokens(documents(spark), cache, BYTES).collect()), key=str) == want


def test_stored_counts_are_not_encoded_again(spark):
    cache = shared_path(spark, "test-counts")
    df = spark.createDataFrame([(1, "one text")], "doc_id bigint, text string")
    token_counts.count_tokens(df, cache, BYTES).collect()
    marked = token_counts.read_cache(spark, cache).selectExpr("version", "digest", "n_tokens + 1000 as n_tokens")
    other = shared_path(spark, "test-counts")
    marked.write.parquet(other)
    assert token_counts.count_tokens(df, other, BYTES).first()["n_tokens"] == 1002


def grammar(ids, sizes):
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    return token_files.compress(np.array(ids, np.uint32), ends, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=80), min_size=1, max_size=8))
def test_grammar_round_trip(docs):
    ids = [np.array(d, np.uint32) for d in docs]
    shard = token_files.Shard.parse(token_files.pack(list(range(len(ids))), ids, 100))
    flat = np.concatenate(ids)
    for k, d in enumerate(ids):
        assert (shard.doc(k) == d).all()
    assert (shard.expand(shard.symbols) == flat).all()
    for a, b in ((0, 1), (0, len(flat)), (len(flat) // 3, len(flat) // 2 + 1), (len(flat) - 1, len(flat))):
        assert (shard.ids(a, b) == flat[a:b]).all()


def test_grammar_shrinks_and_stays_inside_documents():
    ids = [1, 2, 3, 4] * 200
    rules, lengths, seq, ends = grammar(ids, [400, 400])
    assert len(seq) < 60 and ends.sum() == 2
    assert all(lengths[i] == sum(1 if s < 100 else lengths[s - 100] for s in r) for i, r in enumerate(rules))


def test_damaged_shards_are_refused():
    data = bytearray(token_files.pack([1], [np.arange(50, dtype=np.uint32)], 100))
    data[40] ^= 1
    with pytest.raises(ValueError):
        token_files.Shard.parse(bytes(data))


@pytest.mark.parametrize("shard_ids", [200, 1 << 20])
def test_token_files_against_the_library(spark, shard_ids):
    tok = Tokenizer.from_file(WORDS)
    got = sorted(map(tuple, token_files.token_files(documents(spark), WORDS, shard_ids=shard_ids).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    crc = lambda t: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted(((r[0], r[3]) for r in got), key=str) == sorted(((r[0], crc(r[1])) for r in rows()), key=str)


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_files(empty(spark), WORDS).count() == 0


def test_long_pieces_are_not_remembered():
    from corpusflow.llm import encoding

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, mine = Tokenizer.from_file(path), encoding.Words(path)
    texts = ["x" * 5000 + " short words", "é" * 300 + ", " + "ab1" * 400 + "."]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in mine.ids(texts)] == want
    assert mine.known and max(map(len, mine.known)) <= encoding.LONGEST


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=400), st.integers(1, 40), st.booleans())
def test_no_frequent_pair_is_left(ids, doc, exact):
    """Also where pairs are counted in buckets."""
    flat = np.array(ids * 3, np.uint32)
    ends = np.zeros(len(flat), bool)
    ends[doc - 1::doc] = ends[-1] = True
    bound, token_files.EXACT = token_files.EXACT, token_files.EXACT if exact else 8
    try:
        rules, lengths, seq, marks = token_files.compress(flat, ends, 6)
    finally:
        token_files.EXACT = bound
    shard = token_files.Shard(6, rules, lengths, seq, None)
    assert (shard.expand(seq) == flat).all() and len(shard.expand(seq)) == shard.sizes(seq).sum()
    assert (np.cumsum(shard.sizes(seq))[marks].astype(int) - 1 == np.flatnonzero(ends)).all()
    left = {}
    at = 0
    while at < len(seq) - 1:  # occurrences that do not overlap
        if not marks[at]:
            pair = (seq[at], seq[at + 1])
            run = 1
            while at + run < len(seq) and seq[at + run] == seq[at] and not marks[at + run - 1]:
                run += 1
            if run > 2:
                left[(seq[at], seq[at])] = left.get((seq[at], seq[at]), 0) + run - 1
                at += run - 1
                continue
            left[pair] = left.get(pair, 0) + 1
        at += 1
    assert all(n < token_files.MIN_COUNT for n in left.values())


def test_a_few_texts_of_a_batch_are_objects_at_a_time():
    import pyarrow as pa

    from corpusflow.llm.encoding import BLOCK, sliced

    texts = [f"text {i}" for i in range(3 * BLOCK + 1)]
    parts = list(sliced(pa.array(texts)))
    assert [len(p) for p in parts] == [BLOCK] * 3 + [1] and sum(parts, []) == texts
    assert list(sliced(pa.array([], pa.string()))) == []
