"""Problem 6: encoding of a corpus with a public byte-level BPE tokenizer.

Forced-boundary splitting: a pair of bytes that occurs inside no token of the vocabulary is a
certain cut, as no merge can ever span it. The fragments between certain cuts are encoded on
their own, each distinct fragment once per worker, and the ids are concatenated. The table of
byte pairs comes from the vocabulary file (65,536 flags); the cuts of a whole Arrow batch are
found at once on its code points.

The tokenizer also splits a text by a pattern before merging. A cut must not change those
pieces, so two kinds of places are never cut although their byte pair is free: after white
space, whose run is split by what follows it, and before an apostrophe that follows anything but a
letter or a digit, since a fragment that starts with it could be read as a contraction.

Null and empty texts have the empty list. Special tokens' strings are ordinary text. Ids are
those of the vocabulary file; nothing is truncated, whatever the text's length. Other columns
of the table are not read, and repeated rows come out as often as they stand.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The pattern by which the public vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments that a worker keeps with their ids.
KEPT = 400_000
#: Marks put into a batch at its cuts and at the ends of its texts: code points that are no characters.
CUT, END = "\U0010FFFF", "\U0010FFFE"
#: Code points of a part of a batch that is cut at once.
PART = 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Splitter:
    """Certain cuts of texts for a vocabulary of byte strings."""

    def __init__(self, vocabulary) -> None:
        inside = np.zeros(65536, dtype=bool)
        for t in vocabulary:
            if len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8).astype(np.int32)
                inside[b[:-1] * 256 + b[1:]] = True
        self.free = ~inside
        points = [chr(i) if not 0xD800 <= i < 0xE000 else "�" for i in range(65536)]
        coded = [p.encode() for p in points]
        self.first = np.array([c[0] for c in coded], dtype=np.int32)
        self.last = np.array([c[-1] for c in coded], dtype=np.int32)
        space, word = regex.compile(r"\s"), regex.compile(r"[\p{L}\p{N}]")
        self.space = np.array([bool(space.match(p)) for p in points])
        self.word = np.array([bool(word.match(p)) for p in points])

    def cuts(self, text: str) -> np.ndarray:
        """Places in ``text``, in code points, where it may be cut."""
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(at) < 2:
            return np.zeros(0, dtype=np.int64)
        low = np.minimum(at, 65535)
        # Beyond the first plane the first byte is 0xF0 to 0xF4 and the last has the lowest six bits.
        first, last = self.first[low], self.last[low]
        high = at > 65535
        if high.any():
            first = np.where(high, 0xF0 | (at >> 18).astype(np.int32), first)
            last = np.where(high, 0x80 | (at & 0x3F).astype(np.int32), last)
        left, right = low[:-1], low[1:]
        ok = self.free[last[:-1] * 256 + first[1:]] & ~self.space[left]
        ok &= (right != 0x27) | (self.word[left] & ~high[:-1])
        return np.flatnonzero(ok) + 1


class Encoder(dict):
    """Ids of a text; as a mapping, ids of a fragment, kept up to ``KEPT`` fragments."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = load_ranks(path)
        self.splitter = Splitter(ranks)
        self.model = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, fragment: str) -> list[int]:
        ids = self.model.encode_ordinary(fragment)
        if len(self) < KEPT:
            self[fragment] = ids
        return ids

    def fragments(self, texts: list[str]) -> Iterator[list[str]]:
        """The fragments of each text; texts are cut in parts of about ``PART`` code points."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > PART:
                yield from self._part(part)
                part, size = [], 0
        if part:
            yield from self._part(part)

    def _part(self, texts: list[str]) -> Iterator[list[str]]:
        joined = "".join(texts)
        if CUT in joined or END in joined:  # the marks themselves stand in a text: cut by places
            for t in texts:
                places = [0, *self.splitter.cuts(t).tolist(), len(t)]
                yield [t[a:b] for a, b in zip(places, places[1:]) if b > a]
            return
        ends = np.cumsum([len(t) for t in texts])
        at = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cuts = np.setdiff1d(self.splitter.cuts(joined), ends, assume_unique=False)
        marks = np.concatenate([np.full(len(cuts), ord(CUT), np.uint32), np.full(len(ends), ord(END), np.uint32)])
        marked = np.insert(at, np.concatenate([cuts, ends]), marks).tobytes().decode("utf-32-le", "surrogatepass")
        for t in marked.split(END)[:-1]:
            yield t.split(CUT) if t else []

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        get = self.__getitem__
        for f in self.fragments(texts):
            yield list(chain.from_iterable(map(get, f)))

    def counts(self, texts: list[str]) -> Iterator[int]:
        get = self.__getitem__
        for f in self.fragments(texts):
            yield sum(map(len, map(get, f)))


_LOADED: dict[str, object] = {}


def loaded(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode_column(df: DataFrame, ident: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """``(ident, ids array<int>)`` of each row of ``df``, with no shuffle."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = loaded(path)
        for b in batches:
            flat, offsets = [], [0]
            for ids in enc.encode([t or "" for t in b.column(1).to_pylist()]):
                flat.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[ident, out])

    return df.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, {out} array<int>")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def decode_column(df: DataFrame, ident: str, ids: str, path: str, out: str = "text") -> DataFrame:
    """``(ident, text)``: the texts of lists of ids."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[ident, out])

    return df.select(ident, ids).mapInArrow(run, f"`{ident}` {kind}, {out} string")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as its ids give it back, by its digest."""
    back = decode_column(p6_ids(spark, d), "doc_id", "ids", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return back.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL = {"p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents"}
