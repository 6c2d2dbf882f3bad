"""Fingerprints of a text: sets of string hashes of chosen word or character n-grams."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from stemmata.functions import tokenize as tk

SPAN = 10_000_000
WIDE = (1 << 61) - 1  # for searches: in a large corpus every value of the small span would be common
ANCHORS = "ul ay oo yo si ca am ie mo rt".split()
_BLANKS = re.compile(r"[ \t\n\f\r\v]+")


@lru_cache(1 << 16)
def string_hash(s: str, span: int = SPAN) -> int:
    """Shift-and-xor over code points in unbounded integers, reduced at the end; '' is 0, one character its code point."""
    if len(s) < 2:
        return ord(s) if s else 0
    h = ord(s[0])
    for c in s[1:]:
        h ^= ord(c) + (h << 6) + (h >> 2)
    return h % span


def character_hashes(text: str, k: int, span: int = SPAN) -> np.ndarray:
    """The hash of the k characters at each place; in int64 where its bits suffice."""
    if len(text) < k:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if k > 1 and int(codes.max()).bit_length() + 1 + 6 * (k - 1) > 62:
        return np.array([string_hash(text[i : i + k], span) for i in range(len(text) - k + 1)], np.int64)
    n = len(codes) - k + 1
    h = codes[:n].copy()
    for j in range(1, k):
        h ^= codes[j : j + n] + (h << 6) + (h >> 2)
    return _reduced(h, span) if k > 1 else h


def _reduced(h: np.ndarray, span: int) -> np.ndarray:
    """``h`` modulo ``span``; hashes of plain letters mostly lie below a wide one already."""
    return h % span if len(h) and int(h.max()) >= span else h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least hash of each window, where it is new or stands in the last place; the first window's is new unless it stands first."""
    if len(hashes) < window:
        return hashes[:0]
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1)
    before = np.concatenate([hashes[:1], least[:-1]])
    return least[(least != before) | (hashes[window - 1 :] == least)]


def plain(text: str) -> str:
    """What winnowing reads: lower case, without punctuation and blanks."""
    return _BLANKS.sub("", tk.without_punctuation(text).lower())


def _words(text: str) -> list[str]:
    return tk.strip_punctuation([text[a:b] for a, b in tk.words(text)])


def _full(text: str, n: int, k: int) -> list[str]:
    w = _words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def _kth_in_sent(text: str, n: int, k: int) -> list[str]:
    out = []
    for a, b in tk.sentences(text):
        w = _words(text[a:b])
        out.append(" ".join(w[min(k, len(w) - min(n, len(w))) : min(k + n, len(w))]))
    return out


def _anchor(text: str, n: int, k: int, anchors: list[str] = ANCHORS) -> list[str]:
    """n-grams around words that hold an anchor. At the end of the text one with n - 1 words counts too."""
    w, out = _words(text), []
    for i, word in enumerate(w):
        if any(a in word for a in anchors):
            start, end = max(0, i - (n - 1) // 2), min(i + n // 2, len(w)) + 1
            if end - start == n:
                out.append(" ".join(w[start:end]))
    return out


GRAMS = {"full": _full, "kth_in_sent": _kth_in_sent, "anchor": _anchor}


def grams(text: str, method: str, n: int, k: int = 0) -> list[str]:
    """The word n-grams that a method chooses, in order."""
    return GRAMS[method](text, n, k)


def fingerprint(text: str, method: str, n: int, k: int = 0, span: int = SPAN) -> list[int]:
    """The set of a text's hashes, sorted. ``winnow-k`` takes n characters and guarantees matches of k, ``n <= k``."""
    if method == "winnow-k":
        if k < n:
            raise ValueError("winnow-k needs k of at least n")
        return np.unique(winnow(character_hashes(plain(text), n, span), k - n + 1)).tolist()
    if method not in GRAMS:
        raise ValueError(f"unknown method {method!r}; one of winnow-k, {', '.join(GRAMS)}")
    return sorted({string_hash(g, span) for g in grams(text, method, n, k)})


_DROPPED = np.zeros(129, bool)
_DROPPED[[ord(c) for c in tk.PUNCTUATION + " \t\n\f\r\v"]] = True


def _alone(text: str) -> str | None:
    """``text`` in lower case where each character has one of its own, whatever stands beside it; None where not."""
    lower = text.lower()
    return lower if len(lower) == len(text) and "\u03a3" not in text else None


def _minima(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours, by doubling."""
    m, size = h, 1
    while 2 * size <= window:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    rest = window - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def winnowed(texts: list[str], cuts: list[list[tk.Span]], n: int, k: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(piece, hash): what ``fingerprint`` by ``winnow-k`` finds in each piece, all texts at once; in order of piece, repeats not removed.

    ``cuts`` are the pieces of each text, in order and apart; they are numbered on from text to text.
    """
    window = k - n + 1
    lowers = [_alone(t) for t in texts]
    codes = np.frombuffer("".join(t or "" for t in lowers).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and n > 1 and int(codes.max()).bit_length() + 1 + 6 * (n - 1) > 62:
        lowers = [t if t is not None and max(map(ord, t), default=0).bit_length() + 1 + 6 * (n - 1) <= 62 else None for t in lowers]
        codes = np.frombuffer("".join(t or "" for t in lowers).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = ~_DROPPED[np.minimum(codes, 128)]
    before = np.concatenate([[0], np.cumsum(kept)])
    bounds, pieces, odd, at, base = [], [], [], 0, 0
    for text, lower, own in zip(texts, lowers, cuts):
        if lower is None:
            odd += [(base + j, np.array(fingerprint(text[a:b], "winnow-k", n, k, span), np.int64)) for j, (a, b) in enumerate(own)]
        else:
            bounds.append(np.array(own, np.int64).reshape(-1, 2) + at)
            pieces.append(np.arange(base, base + len(own)))
            at += len(lower)
        base += len(own)
    place, numbers = (np.concatenate(bounds), np.concatenate(pieces)) if bounds else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    first, last = before[place[:, 0]], before[place[:, 1]]
    there = last - first >= n + window - 1
    first, stop, numbers = first[there], last[there] - (n + window - 2), numbers[there]
    if len(first):
        c = codes[kept].astype(np.int64)
        size = len(c) - n + 1
        h = c[:size].copy()
        for j in range(1, n):
            h ^= c[j : j + size] + (h << 6) + (h >> 2)
        if n > 1:
            h = _reduced(h, span)
        least = _minima(h, window)
        new = h[window - 1 :] == least
        new[1:] |= least[1:] != least[:-1]
        # the first window of a piece has none before it
        new[first] = (least[first] != h[first]) | (h[first + window - 1] == least[first])
        inside = np.zeros(len(least) + 1, np.int8)
        inside[first] += 1
        inside[stop] -= 1
        some = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
        owner, hashes = numbers[np.searchsorted(first, some, "right") - 1], least[some]
    else:
        owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if odd:
        owner = np.concatenate([owner, *(np.full(len(h), j) for j, h in odd)])
        hashes = np.concatenate([hashes, *(h for _, h in odd)])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return owner, hashes
