"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

``model_bytes`` serialises the protobuf by hand: every byte sequence of the vocabulary becomes a piece of
byte-mapped characters (each byte one printable character) with score -rank, after the unknown piece that
sentencepiece asks for; the normaliser is the identity, adds no prefix and touches no white space. sentencepiece
then merges the adjacent pair of least rank first, as the vocabulary's own BPE does. Texts are cut by the
vocabulary's pre-token pattern, pre-tokens are encoded, and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from stemmata.session import prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same for texts of Latin-1 characters, for the faster standard engine
_LETTER, _NUMBER, _BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\x0b\x0c\x85\xa0"
LATIN = rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
CACHE_ENTRIES = 600_000
SEPARATOR = "\ue000"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a piece in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: id 0 is unknown, id rank + 1 the piece of that rank (ranks are 0..n-1)."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[b] for b in by_rank] != list(range(len(by_rank))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary needs ranks 0..n-1 and all 256 bytes")
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    out += [_field(1, _field(1, "".join(chars[b] for b in piece)) + _field(2, -float(rank)) + _field(3, 1)) for rank, piece in enumerate(by_rank)]
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.any, self.latin = regex.compile(pattern).findall, re.compile(LATIN).findall if pattern == PATTERN else None
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens, which tile the text."""
        if self.latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any(text)
            return self.latin(text)
        return self.any(text)

    def _learn(self, tokens: list[str]) -> None:
        if len(self.known) + len(tokens) > CACHE_ENTRIES:
            self.known.clear()
        # one call for all: the separator is in no piece, so nothing merges over it and it comes out as unknown (0)
        mapped = SEPARATOR.join([t.encode("utf-8", "surrogatepass").decode("latin-1") for t in tokens]).translate(self.chars)
        ids = np.array(self.model.encode(mapped), np.int32)
        cut = np.flatnonzero(ids == 0)
        raw = (ids - 1).tobytes()
        ends = [*(cut * 4).tolist(), len(raw)]
        begins = [0, *(cut * 4 + 4).tolist()]
        self.known.update(zip(tokens, [raw[a:b] for a, b in zip(begins, ends)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The int32 ids of each text as bytes; none for null."""
        split = [self.split(text) if text else [] for text in texts]
        for at in range(0, len(split), 64):
            part = split[at : at + 64]
            new = set().union(*part).difference(self.known)
            if new:
                if len(self.known) + len(new) > CACHE_ENTRIES:
                    self.known.clear()
                    new = set().union(*part)
                self._learn(list(new))
            get = self.known.__getitem__
            split[at : at + 64] = [b"".join(map(get, tokens)) for tokens in part]
        return split

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])


class Vocabulary(NamedTuple):
    """A rank file's bytes as the driver read them, sent to each executor once, and their digest."""

    raw: Broadcast
    digest: str

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Vocabulary:
        raw = Path(path).read_bytes()
        return cls(spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: Vocabulary, pattern: str) -> Codec:
    """The codec of a worker, made once for each vocabulary and pattern."""
    key = (vocabulary.digest, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(vocabulary.raw.value), pattern)
    return _codecs[key]


ENCODED = "doc_id bigint, token_ids array<int>, n_tokens int, n_bytes bigint, round_trip boolean"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(vocabulary, pattern)
    for batch in batches:
        # some hundred texts at a time: their ids take several times the texts' room
        for at in range(0, batch.num_rows, 256):
            texts = batch.column(1).slice(at, 256).to_pylist()
            ids = c.encode(texts)
            sizes = np.array([len(b) // 4 for b in ids])
            flat = np.frombuffer(b"".join(ids), np.int32)
            null = np.array([t is None for t in texts])
            ends = np.cumsum(sizes)
            raw = ["" if t is None else t for t in texts]
            same = [c.decode(flat[e - s : e]) == t.encode("utf-8", "surrogatepass") for t, s, e in zip(raw, sizes, ends)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat), mask=pa.array(null))
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 256), lists, pa.array(sizes.astype(np.int32), mask=null), pa.array(np.array(n_bytes, np.int64), mask=null), pa.array(same, mask=null)],
                ["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"],
            )


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids, n_tokens, n_bytes, round_trip) of each row of ``docs(doc_id, text)``.

    ``round_trip`` says that decoding gives the text's bytes back. A null text has null in every column but doc_id;
    an empty one has no tokens. Rows repeat as they come; null ids stay null; texts of any length are encoded whole; an empty table
    gives an empty result; other columns are ignored. ``path`` names a rank file that the driver reads.
    """
    from pyspark.sql import functions as F

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_encode, vocabulary=Vocabulary.of(docs.sparkSession, path), pattern=pattern), ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(vocabulary, pattern)
    for batch in batches:
        texts = [None if ids is None else c.decode(np.asarray(ids, np.int32)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text, no ids an empty one, bytes that aren't UTF-8 U+FFFD.

    Rows repeat as they come; an empty table gives an empty result; other columns are ignored.
    """
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "token_ids").mapInArrow(partial(_decode, vocabulary=Vocabulary.of(encoded.sparkSession, path), pattern=pattern), "doc_id bigint, text string")
