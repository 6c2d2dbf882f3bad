"""Cutting a text into spans: words, sentences, paragraphs, lines, fixed-size pieces. Offsets count code points."""

from __future__ import annotations

import re
from itertools import accumulate

BLANK = r"[ \t\n\f\r]"
_P = r"""'"(){}\[\]*@:;!?,`"""
#: Alternatives, the last of which takes any character: matches tile the text. Without lookaround, for engines that
#: lack it; there a word before an ellipsis keeps the first of its dots.
TOKEN = rf"-{{2,}}|\.{{2,}}|'?(?:[^ \t\n\f\r{_P}\-.]|-[^ \t\n\f\r{_P}\-]|\.[^ \t\n\f\r{_P}.\-])+\.?|[^ \t\n\f\r]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(TOKEN.replace(r")+\.?|", r")+(?:\.(?!\.))?|"))
_TILE = re.compile(rf"{BLANK}*(?:{_WORD.pattern})")
_STOP = re.compile(rf"[.!?]+[\"')\]]*{BLANK}+")
_PARAGRAPH = re.compile(rf"{BLANK}*\n\n+{BLANK}*")
_LINE = re.compile(rf"{BLANK}*\n{BLANK}*")
_STRIP = " \t\n\f\r"
_DROP = str.maketrans("", "", PUNCTUATION)

Span = tuple[int, int]


def words(text: str, n: int = 0) -> list[Span]:
    """Tokens: a final period stays attached, commas and quotes stand alone, runs of dashes or dots are one."""
    return [m.span() for m in _WORD.finditer(text)]


def tokens(text: str) -> tuple[list[str], list[int]]:
    """The tokens of ``words`` with where each ends: each match with the blanks before it tiles the text, so only lengths are added up."""
    tiles = _TILE.findall(text)
    return [t.lstrip(_STRIP) for t in tiles], list(accumulate(map(len, tiles)))


def sentences(text: str, n: int = 0) -> list[Span]:
    """Runs up to a terminator (with closing quotes) that blanks follow, without blanks around; empty ones are left out."""
    out, at = [], 0
    for end in [*(m.end() for m in _STOP.finditer(text)), len(text)]:
        piece = text[at:end]
        start = at + len(piece) - len(piece.lstrip(_STRIP))
        stop = at + len(piece.rstrip(_STRIP))
        if stop > start:
            out.append((start, stop))
        at = end
    return out


def _between(pattern: re.Pattern[str], text: str) -> list[Span]:
    out, at = [], 0
    for m in pattern.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def paragraphs(text: str, n: int = 0) -> list[Span]:
    """What lies between blank lines. The first begins at 0 and may be empty; none follows a final boundary."""
    return _between(_PARAGRAPH, text)


def lines(text: str, n: int = 0) -> list[Span]:
    """What lies between line feeds, without blanks around them; empty ones are left out (our own addition)."""
    return [s for s in _between(_LINE, text) if s[1] > s[0]]


def nchars(text: str, n: int = 5000) -> list[Span]:
    """Pieces of n characters; the last takes the remainder too, so it has n to 2n - 1, or all of a shorter text."""
    count = max(1, len(text) // n)
    return [(k * n, (k + 1) * n if k < count - 1 else len(text)) for k in range(count)]


def full(text: str, n: int = 0) -> list[Span]:
    return [(0, len(text))]


KINDS = {"word": words, "sentence": sentences, "paragraph": paragraphs, "line": lines, "nchars": nchars, "full": full}


def tokenize(text: str, kind: str, n: int = 5000) -> list[Span]:
    """Spans of a text; a final byte-order mark at its start is not part of it. Unknown kinds are an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown atom type {kind!r}; one of {', '.join(KINDS)}")
    return KINDS[kind](text, n)


def strip_punctuation(tokens: list[str]) -> list[str]:
    """Tokens that aren't a run of the punctuation characters in their order, without punctuation characters; ``...`` stays, empty."""
    return [t.translate(_DROP) for t in tokens if t not in PUNCTUATION]


def without_punctuation(text: str) -> str:
    return text.translate(_DROP)
