"""Files that tasks write below the shared folder, whatever its file system."""

from __future__ import annotations

import re

from pyarrow import fs as pafs


#: fixed values: Hadoop's names of object stores that Arrow knows by another
ALIASES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(uri: str):
    """``(filesystem, path)`` of a path with or without a scheme, under Hadoop's or Arrow's name of it."""
    uri = re.sub(r"^file:/+", "/", uri)
    scheme, colon, rest = uri.partition("://")
    if colon:
        uri = f"{ALIASES.get(scheme, scheme)}://{rest}"
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_file(uri: str, data: bytes) -> None:
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def stream_file(uri: str, chunk: int = 1 << 20):
    """The bytes of a file, piece by piece."""
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f:
        while data := f.read(chunk):
            yield data
