"""Vectorised words over Arrow text: a batch is one byte buffer, words are found and hashed without a Python loop.

A word is a maximal run of ASCII letters, digits, ``_`` and bytes above 127 (so any non-ASCII character is a
word character). Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_U = np.uint64
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values, in place."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of a chunk: byte starts and ends in ``buf``, hashes, and of each text the first word's index."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_texts + 1


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and n + 1 offsets into them."""
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(col: pa.Array, limit: int = 1 << 21, rows: int = 1 << 16) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes and at most ``rows`` texts, with the index of their first row; a longer text is a slice of its own."""
    col = pc.fill_null(col, "")
    if not len(col):
        return
    size = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        base = size[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(size, base + limit, "right"))))
        yield at, col.slice(at, end - at)
        at = end


def spaced(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One buffer: a blank before the first text and after each; offsets of the texts' first bytes (n + 1)."""
    if lower:
        col = pc.utf8_lower(col)
    buf, off = buffer(pc.binary_join_element_wise(col, pa.scalar("", col.type), pa.scalar(" ", col.type)))
    out = np.empty(len(buf) + 1, np.uint8)
    out[0] = 32
    out[1:] = buf
    return out, off + 1


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c and q so that the bytes i..j-1 hash to (c[j] - c[i]) * q[i], whatever i is."""
    p, q = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=c[1:])
    return c, q


def words(col: pa.Array, lower: bool = True) -> Words:
    buf, begin = spaced(col, lower)
    word = IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the buffer begins and ends with a blank
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        c, q = prefix(buf[base : ends[to - 1]])
        i, j = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = (c[j] - c[i]) * q[i]
        at = to
    return Words(buf, starts, ends, mix(hashes), np.searchsorted(starts, begin))


def word_hash(word: str) -> int:
    """The hash of one word, as ``words`` gives it."""
    return int(words(pa.array([word])).hashes[0])


def int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
