"""Archives and toxicity."""

import base64
import hashlib
import struct

import pytest
import zstandard
from awkward import prose
from pyspark.sql import functions as F

from corpusflow.llm import toxicity, warc

PAGES = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, "http://b/ü ?q=1", "<p>same</p>"), (3, None, ""), (4, "u", None),
         (5, "u", "<p>" + prose(1, 20_000) + "</p>"), (None, "u", "<p>same</p>"), (6, "u", "\r\n\r\nWARC/1.1\r\n"),
         (7, "u", "once"), (1, "http://a/\r\nX: y", "<p>same</p>"), (-3, "u", "once")]


def pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("file", F.lit("clash"))


def expected(data, min_bytes):
    first = {}
    for p, _, h in data:
        h = h or ""
        if p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in data:
        h = (h or "").encode()
        f = first.get(h.decode())
        revisit = len(h) >= min_bytes and f is not None and p != f
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response",
                    f if revisit else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_round_trip(spark, min_bytes):
    back = warc.round_trip(pages(spark), min_bytes)
    got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(PAGES, min_bytes), key=str)
    html = {r["page_id"]: bytes(r["payload"]).decode() for r in back.where("payload is not null").collect()}
    assert html[5] == PAGES[4][2] and html[6] == PAGES[6][2]


def test_no_pages_no_files(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def many(n):
    return [warc.record(i, f"http://x/{i}", prose(i, 60).encode(), None) for i in range(n)]


def test_dictionary_comes_first_and_every_record_is_a_frame():
    records = many(80)
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    own = zstandard.ZstdCompressionDict(data[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
    assert first.decompress(data[8 + size:]) == records[0] and first.eof
    assert list(warc.frames(iter([data]))) == records
    assert list(warc.frames(data[i:i + 7] for i in range(0, len(data), 7))) == records  # any cut of the stream


def test_damaged_archives_are_refused():
    data = warc.archive(many(3))
    with pytest.raises(ValueError):
        list(warc.frames(iter([data[:-4]])))
    with pytest.raises(ValueError):
        list(warc.frames(iter([b"\0" * 20])))
    with pytest.raises(zstandard.ZstdError):
        list(warc.frames(iter([data[:-6] + b"\0\0" + data[-4:]])))


@pytest.mark.parametrize("old,new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"Content-Length: 1", b"Content-Length: 2"),
    (b"payload", b"pAyload"), (b"HTTP/1.1", b"HTTP:1.1"), (b"x-page:5", b"x-page:z")])
def test_bad_records_are_refused(old, new):
    good = warc.record(5, "u", b"the payload", None)
    assert warc.parse(good)["payload"] == b"the payload"
    with pytest.raises((ValueError, KeyError)):
        warc.parse(good.replace(old, new))
    with pytest.raises(ValueError):
        warc.parse(good + b"x")


@pytest.mark.parametrize("text,words", [
    ("An IDIOT!", ["an", "idiot"]), ("1d10t", ["idiot"]), ("іdіоt", ["idiot"]), ("ídïöt", ["idiot"]), ("iiidiot", ["idiot"]),
    ("ｉｄｉｏｔ", ["idiot"]), ("$cum tr@sh", ["scum", "trash"]), ("in 1999", ["in", "1999"]), (None, []), ("", []), (" \n", [])])
def test_folding(text, words):
    assert toxicity.fold(text) == words


def test_exception_phrases_shield_their_words():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idio": 3.0}, ["trash can"])
    found = lexicon.automaton()
    assert toxicity.matched(found, toxicity.fold("a trash can")) == {}
    assert toxicity.matched(found, toxicity.fold("a trash can and trash")) == {"trash": 2.0}
    assert toxicity.matched(found, toxicity.fold("idiots and idiocy, trashy")) == {"idiots": 3.0, "idiocy": 3.0}
    assert toxicity.evidence(found, "trash " * 4 + "b c d") == (2.0, 0.5)


def corpus(spark):
    rows, labels = [], []
    for i in range(600):
        text = prose(i, 40, 500)
        bad = i % 5 == 0
        if bad:
            text = text.replace("w1", "moron w1", 1) + " M0RON scum"
        elif i % 7 == 0:
            text += " scum pond"
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1))
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learned_lexicon_with_exceptions(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, labels)
    assert " moron " in lexicon.weights
    assert "scum pond" in lexicon.exceptions or " scum " not in lexicon.weights
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "you m o r o n moron"), (None, "Mоrоn " * 3), (9004, "a " * 100_000)],
                                 "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(more, lexicon).collect()}
    assert len(got) == 5 and all(0 <= v <= 1 for v in got.values())
    assert got[9001] == got[9002] == got[9004] < 0.3 < min(got[9003], got[None])
    assert toxicity.score(docs, lexicon).where("score >= 0.3").count() == 120


def test_without_labels(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {round(r["score"], 3) for r in toxicity.score(docs, lexicon).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    from corpusflow.llm.queries_text import op6_toxicity

    sf = "/root/testdata/sf0.1"
    got = op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.9 and hit / (got.predicted == 1).sum() > 0.88


def plain_matches(lexicon, text):
    """Distinct matched words by looking at every place of the folded text."""
    line = f" {' '.join(toxicity.fold(text))} "
    shielded = [(i, i + len(p) + 2) for p in lexicon.exceptions for i in range(len(line)) if line.startswith(f" {p} ", i)]
    out = {}
    for i in range(len(line)):
        for entry, weight in lexicon.weights.items():
            if line.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in shielded):
                word = line[i:].split()[0]
                out[word] = max(out.get(word, 0.0), weight)
    return out


def test_matches_equal_plain_search():
    lexicon = toxicity.Lexicon({" wi ": 1.0, " wi": 0.5, " wi2": 2.0, " wi2e ": 4.0, " trash ": 3.0, " tras": 1.5, " a ": 0.25},
                               ["trash can", "wi w2", "wi2 wi"])
    found = lexicon.automaton()
    texts = [prose(i, 60, 300) for i in range(40)] + ["tr@sh can trash cans trash", "w1 w2 w1 w12 w1 w1", "a a a", "w123", "", None, "!?"]
    assert any(plain_matches(lexicon, t) for t in texts[:40])
    for t in texts:
        assert toxicity.matched(found, toxicity.fold(t)) == plain_matches(lexicon, t)


def test_training_batches_without_words_or_matches(spark):
    docs, labels = corpus(spark)
    # one partition without any word, one without any match, one with both, and an empty one
    blank = docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.lit(" .,\n").alias("text"), "score").limit(5).repartition(1)
    clean = docs.select((F.col("doc_id") + 2000).alias("doc_id"), F.lit("plain words only").alias("text"), "score").limit(50).repartition(1)
    more = labels.select((F.col("doc_id") + 1000).alias("doc_id"), F.lit(0).alias("toxic")).union(
        labels.select((F.col("doc_id") + 2000).alias("doc_id"), F.lit(0).alias("toxic")))
    lexicon = toxicity.learn(docs.union(blank).union(clean).union(docs.limit(0)), labels.union(more))
    assert " moron " in lexicon.weights
    # no match anywhere: toxic and other texts of the same words
    same = docs.select("doc_id", F.lit("the same few words").alias("text"))
    assert toxicity.learn(same, labels).weights == {}


def test_toxicity_of_repeated_rows_long_texts_and_clashing_columns(spark):
    docs, labels = corpus(spark)
    twice = docs.union(docs.limit(100)).withColumns({"toxic": F.lit(0), "y": F.lit("y"), "word": F.lit("w"), "neg": F.lit(1), "key": F.lit("k")})
    marked = labels.union(labels).withColumns({"text": F.lit("moron"), "score": F.lit(1)})
    lexicon = toxicity.learn(twice, marked)
    long = spark.createDataFrame([(1, "moron " + "x" * 3_000_000, 7), (2, prose(9, 200_000), 7), (3, "moron " * 50, 7)] * 2,
                                 "doc_id bigint, text string, evidence int")
    got = toxicity.score(long, lexicon).groupBy("doc_id").agg(F.count("score").alias("n"), F.countDistinct("score").alias("d")).collect()
    assert sorted((r["doc_id"], r["n"], r["d"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_very_long_pages_and_clashing_columns(spark):
    data = [(1, "u", "<p>" + prose(2, 400_000) + "</p>"), (2, "v", "y" * 3_000_000), (3, "w", None), (2, "v", "y" * 3_000_000)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    df = df.withColumns({c: F.lit("clash") for c in ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "part", "seq")})
    got = warc.round_trip(df, 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(data, 0), key=str)


def test_hadoop_names_of_object_stores():
    from corpusflow.llm import files

    asked = []

    class Known:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    real, files.pafs.FileSystem = files.pafs.FileSystem, Known
    try:
        for uri in ("s3a://b/k", "s3n://b/k", "gs://b/k", "hdfs://n:8020/p", "abfss://c@a/p"):
            files.filesystem(uri)
    finally:
        files.pafs.FileSystem = real
    assert asked == ["s3://b/k", "s3://b/k", "gs://b/k", "hdfs://n:8020/p", "abfss://c@a/p"]
    assert files.filesystem("file:///tmp/x")[1] == files.filesystem("/tmp/x")[1] == "/tmp/x"
