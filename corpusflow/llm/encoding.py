"""Public tokenizers inside tasks, with a bounded memory of pieces.

Both vocabularies split a text before they merge, so a text is encoded piece by
piece and equal pieces are encoded once per worker.  A cut is made only where
no token can reach across:

* between a character that is no white space in any definition and an ASCII
  white space.  Byte-level BPE keeps white space: its pattern begins a new match
  there, and the look-ahead of a run of white space sees only what follows in
  the piece.  Word BPE drops white space, and neither normal form C nor
  lower-casing reaches across it, so it may be cut at any white space;
* between a letter and a run of ASCII signs at the piece's end (the patterns keep runs of
  letters and runs of signs apart); not at an apostrophe, nor at the signs of special strings.

Special strings hold no white space, and a piece with one goes to the library
whole.  New pieces of plain Latin letters, on which normalisers do nothing but
lower the case, go straight to the library's model in its byte alphabet, others
through the library's whole chain.  Tests hold both classes against the library's own encoding of
whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: pieces remembered by a worker: half of them new, half of an older generation
PIECES = 400_000
#: characters of the longest piece that is remembered, which bounds the memory in bytes
LONGEST = 128
#: texts whose pieces are looked up together
BLOCK = 64
#: bytes of texts whose words are told apart together
BLOCK_BYTES = 1 << 23
_DOUBLE = re.compile(r"\s[ \t-\r]")
_SIMPLE = re.compile(r"[ \t-\r]?[^ \t-\r]+|[ \t-\r]")
_BORDER = re.compile(r"(?<=\S)(?=[ \t-\r])")
_SIGNS = ".,!?;:#$%&*+-/=@^_~()[]{}\"\\"

# The byte alphabet of byte-level BPE: printable bytes stand for themselves, the
# others for the code points from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def latin(word: str) -> str | None:
    """A word of Latin letters in the byte alphabet; None for anything else."""
    if not word.isalpha():
        return None
    if word.isascii():
        return word
    if max(word) >= "\u0180" or "\u0130" in word:  # beyond, forms and cases are not so plain
        return None
    return word.encode().decode("latin-1").translate(_BYTES)


def sliced(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, a block at a time."""
    for i in range(0, len(texts), BLOCK):
        yield texts.slice(i, BLOCK).to_pylist()


def pieces(text: str) -> list[str]:
    """Cuts a text at white space; the pieces joined are the text."""
    return _BORDER.split(text) if _DOUBLE.search(text) else _SIMPLE.findall(text)


class _Memory:
    """piece -> what ``take`` makes of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict = {}
        self.old: dict = {}
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model

    def plain(self, piece: str) -> str | None:
        """The model's input for a piece of plain letters."""
        raise NotImplementedError

    def fresh(self, new: set[str]) -> dict:
        """The new pieces, and the parts that some of them were cut into."""
        known, out = self.known, {}
        parts = {}
        for p in new:
            if p[-1:] in _SIGNS and (a := p.rstrip(_SIGNS))[-1:].isalpha():
                parts[p] = a, p[len(a):]
        rest = []
        for p in {q for p in new for q in parts.get(p, (p,))}.difference(known):
            plain = self.plain(p)
            if plain is None:
                rest.append(p)
            else:
                out[p] = self.take([t.id for t in self.model.tokenize(plain)])
        for p, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            out[p] = self.take(e.ids)
        for p, (a, b) in parts.items():
            out[p] = (out[a] if a in out else known[a]) + (out[b] if b in out else known[b])
        return out

    def learn(self, wanted: set[str]) -> Mapping:
        """What the wanted pieces, none of them known, are.  Pieces of more than ``LONGEST``
        characters are forgotten with their block of texts."""
        long = {p for p in wanted if len(p) > LONGEST}
        short = wanted.difference(long) if long else wanted
        if len(self.known) + 2 * len(short) > PIECES // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        known.update({p: old[p] for p in short if p in old})
        known.update(self.fresh(short.difference(known)))
        return ChainMap(self.fresh(long), known) if long else known

    def looked_up(self, texts: list[str]) -> Iterator[list]:
        """What the memory has for the pieces of each text, a block of texts at a time."""
        for i in range(0, len(texts), BLOCK):
            found = [self.cut(t) for t in texts[i:i + BLOCK]]
            get = self.known.get
            got = [list(map(get, f)) for f in found]
            open_ = [k for k, g in enumerate(got) if None in g]
            if open_:
                made = self.learn({p for k in open_ for p, x in zip(found[k], got[k]) if x is None})
                for k in open_:
                    got[k] = [made[p] if x is None else x for p, x in zip(found[k], got[k])]
            yield from got


class Counts(_Memory):
    """Token counts, for vocabularies that keep white space."""

    take = staticmethod(len)
    cut = staticmethod(pieces)

    def plain(self, piece: str) -> str | None:
        if piece[0] != " ":
            return latin(piece)
        word = latin(piece[1:])
        return word and chr(_BYTES[32]) + word

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(found) for found in self.looked_up(texts)]


class Words(_Memory):
    """Token ids as bytes, for vocabularies that drop white space."""

    @staticmethod
    def take(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def plain(self, piece: str) -> str | None:
        return latin(piece.lower())

    def ids(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ahead = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        edges = [0, *np.flatnonzero(np.diff(ahead // BLOCK_BYTES)) + 1, len(texts)]
        for a, z in zip(edges, edges[1:]):
            yield from self.block(texts.slice(a, z - a))

    def block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each different word of the texts is looked up once, and its ids go to all its places."""
        words = pc.ascii_split_whitespace(texts)
        place = words.flatten().dictionary_encode()
        found = place.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, found))
        made = self.learn({p for p, x in zip(found, got) if x is None})
        got = [made[p] if x is None else x for p, x in zip(found, got)]
        ids = pa.array(got, pa.large_binary()).take(place.indices)
        edge = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) // 4
        edge = edge[words.offsets.to_numpy() - words.offsets[0].as_py()]
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")
        for a, z in zip(edge, edge[1:]):
            yield flat[a:z]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counts:
    return Counts(path)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> Words:
    return Words(path)
