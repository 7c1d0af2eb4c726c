"""WARC archives compressed with Zstandard dictionaries.

A ``.warc.zst`` file begins with a skippable frame (magic 0x184D2A5D) that
holds the dictionary, and every record is one Zstandard frame.  The writer
trains a dictionary for each file on a bounded sample of that file's own
records (``DICT_SAMPLES`` records of at most ``DICT_SAMPLE_BYTES`` each) inside the
task that writes it; where training is refused, the sample itself serves as a
raw dictionary.

Records with equal payloads of at least ``min_bytes``: the one with the
smallest page id is a ``response``, the others are ``revisit`` records that refer
to it and carry the HTTP header without the payload.  First ids come from an
aggregate over digests (combined on the map side); the join back has one row
for each repeated digest, so a hot digest can be split.

The reader streams a file, decodes frame by frame with the dictionary of the
leading frame, and validates every record: version line, required headers,
``Content-Length`` against the block, the end mark, and for responses the length
and digest of the payload.  A file's name is new for every attempt of a task and
only the names that finished tasks return are read.

Defined cases: null html is an empty payload; null url has no target header;
null ``page_id`` sorts after all others; equal ids with equal payloads are all
responses; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import keep, shared_path
from corpusflow.llm.files import stream_file, write_file

SKIPPABLE = 0x184D2A5D
DICT_SAMPLES = 256
DICT_SAMPLE_BYTES = 16_384
DICT_BYTES = 16_384
FILE_BYTES = 16 << 20
READ_TASKS = 10_000
#: the archive's date; records of this job have no fetch time of their own
DATE = "1970-01-01T00:00:00Z"
ID = "<urn:x-page:{}>"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; ``first`` is the page id that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
            f"WARC-Record-ID: {ID.format(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {ID.format(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    sample = [r[:DICT_SAMPLE_BYTES] for r in records[:DICT_SAMPLES]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample)
    except zstandard.ZstdError:  # too few or too small
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES])


def archive(records: list[bytes]) -> bytes:
    """An archive file: the dictionary's frame, then one frame for each record."""
    own = train(records)
    data = own.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(press.compress, records)])


def frames(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The decoded records of an archive's bytes, one at a time."""
    held = b""
    chunks = iter(chunks)

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            data = next(chunks, None)
            if data is None:
                return False
            held += data
        return True

    if not more(8):
        raise ValueError("archive: no leading frame")
    magic, size = struct.unpack_from("<II", held)
    if magic != SKIPPABLE or not more(8 + size):
        raise ValueError("archive: no dictionary in the leading frame")
    own = zstandard.ZstdCompressionDict(held[8:8 + size])
    held = held[8 + size:]
    unpress = zstandard.ZstdDecompressor(dict_data=own)
    while more(1):
        frame, out = unpress.decompressobj(), []
        while True:
            out.append(frame.decompress(held))
            held = b""
            if frame.eof:
                held = frame.unused_data
                break
            if not more(1):
                raise ValueError("archive: the last frame is cut off")
        yield b"".join(out)


def _headers(data: bytes) -> dict[str, str]:
    return {k: v.strip() for k, _, v in (line.partition(":") for line in data.decode().split("\r\n"))}


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+|None)>", urn)
    if not m:
        raise ValueError(f"record: odd id {urn!r}")
    return None if m[1] == "None" else int(m[1])


def parse(data: bytes) -> dict:
    """Validate a record and read it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != b"WARC/1.1" or not gap:
        raise ValueError("record: no WARC/1.1 head")
    h = _headers(lines)
    if lacking := [k for k in REQUIRED if k not in h]:
        raise ValueError(f"record: lacks {lacking}")
    size = int(h["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record: Content-Length does not match the block")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("record: the block is no HTTP response")
    n = int(_headers(http.partition(b"\r\n")[2])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = h["WARC-Type"]
    if kind == "response":
        if len(payload) != n or payload_digest(payload) != digest:
            raise ValueError("record: the payload does not match its length and digest")
    elif kind != "revisit" or payload:
        raise ValueError(f"record: odd type {kind!r} or a revisit with a payload")
    refers = _page(h["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": _page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": n,
            "payload_digest": digest, "record_type": kind, "refers_to": refers,
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; the manifest ``file, n_records`` is kept as a table."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"_d": F.sha1("html"), "_n": F.octet_length("html")})
    firsts = (own.where(F.col("_n") >= min_bytes).groupBy("_d")
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
              .drop("_copies"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.col("_first"))
    rows = own.join(firsts, "_d", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", refers.cast("string").alias("first"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def close() -> pd.DataFrame:
            file = f"{path}/{uuid.uuid4().hex}.warc.zst"
            write_file(file, archive(held))
            return pd.DataFrame({"file": [file], "n_records": [len(held)]})

        for b in batches:
            for page_id, url, html, first in zip(b["page_id"], b["url"], b["html"], b["first"]):
                held.append(record(page_id and int(page_id), url, html.encode(), first and int(first)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return keep(rows.mapInPandas(write, "file string, n_records bigint"), "warc-manifest")


SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, payload binary")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the archives named in ``file``; revisits have no payload."""

    def read(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types)))
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, size = [], 0
                for data in frames(stream_file(file)):
                    rows.append(parse(data))
                    size += len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # file names are small rows: without a number, all of them would be merged into one task
    tasks = min(max(files.count(), 1), READ_TASKS)
    return files.select("file").repartition(tasks).mapInArrow(read, SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives below the shared folder and read them back."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc"), min_bytes))
