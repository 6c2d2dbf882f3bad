"""Secret scans that unwrap encodings: a worklist of decoded layers, each scanned, until nothing new appears.

The text is the first layer. From each layer come new ones: its URL escapes decoded, its Unicode escapes decoded, its UTF-16 stretches
narrowed, and every run of base64, folded into lines or not and from each of its first four characters, decoded and, where it is
compressed (gzip, zlib, bzip2, xz, zstd), inflated. What a
decoded run holds doesn't depend on where it stands: each content is scanned once, and its secrets are reported at
every place of the run; a content that holds itself isn't scanned again, so the worklist ends even where codings
run in circles. Every character of a layer carries the span of the original text that it came from, so a finding in
any layer names a span of the text: of plain base64 the groups of four that hold it, of compressed data the whole run.

One RE2 pass over the Arrow batch picks the texts that hold a rule's keyword, an escape or a base64 run, as short as the
scanner takes them; only those reach Python.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.session import prepare

MAX_LAYER_BYTES = 64 << 20
RULES: dict[str, re.Pattern[str]] = {
    "aws-access-key": re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
    "github-token": re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})"),
    "slack-token": re.compile(r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,250}"),
    "google-key": re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "stripe-key": re.compile(r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,250}"),
    "json-web-token": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    "private-key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    "url-password": re.compile(r"(?<=://)[^\s/:@\"'<>]{1,64}:[^\s/:@\"'<>]{3,128}(?=@[A-Za-z0-9.-])"),
    "assigned-secret": re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credentials?)["']?[ \t]{0,8}(?:=>|:=|=|:)[ \t]{0,8}(?:"([^"\s]{12,512})"|'([^'\s]{12,512})'|([A-Za-z0-9_+/=.-]{16,512}))"""),
}
_HINT = (
    r"(?i:token|secret|passwo?r?d|api[_-]?key|access[_-]?key|credential)|A[KS]IA|gh[pousr]_|github_pat_|xox[abeoprs]-|AIza|[rs]k_(?:live|test)_|eyJ|PRIVATE KEY|://[^\s/]+@"
    r"|%[0-9A-Fa-f]{2}|\\[uxU][0-9A-Fa-f{]{2}|[A-Za-z0-9+/_-]{16}|\x00[^\x00]\x00"
)
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_STANDARD = str.maketrans("-_", "+/")
#: ASCII in two bytes a character, either one first
_WIDE = re.compile(r"(?:[\t\n\r -~]\0){8,}|(?:\0[\t\n\r -~]){8,}")
_FOLD = re.compile(r"[ \t]*\r?\n[ \t]*")
#: base64 folded into lines, read as one
_WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{20,}}(?:{_FOLD.pattern}[A-Za-z0-9+/_-]{{20,}})*{_FOLD.pattern}[A-Za-z0-9+/_-]+={{0,2}}")


class Finding(NamedTuple):
    rule: str
    start: int
    end: int
    depth: int
    path: str
    secret: str


class _Layer(NamedTuple):
    text: str
    starts: list[int] | None  # of each character; None: the text itself
    ends: list[int] | None
    path: tuple[str, ...]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None or self.ends is None else (min(self.starts[a:b]), max(self.ends[a:b]))


def _text_of(raw: bytes) -> str:
    """Whatever a run decodes to is scanned, archives and other binaries too; a byte that isn't UTF-8 is a character of its own."""
    return raw.decode("utf-8", "surrogateescape")


def _members(open_member: Callable[[], object], raw: bytes) -> bytes:
    """All members of a compressed file, one after another; content is cut at MAX_LAYER_BYTES + 1."""
    out, top = b"", MAX_LAYER_BYTES + 1
    while raw and len(out) < top:
        d = open_member()
        try:
            new = d.decompress(raw, top - len(out))  # type: ignore[attr-defined]
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            if not out:
                raise
            break  # what follows a whole member is no further one
        out += new
        if not d.unused_data:  # type: ignore[attr-defined]
            break
        raw = d.unused_data  # type: ignore[attr-defined]
    return out


def _inflate(raw: bytes) -> tuple[str, bytes] | None:
    """(kind, content) of compressed data; content is cut at MAX_LAYER_BYTES + 1."""
    try:
        if raw[:2] == b"\x1f\x8b":
            return "gzip", _members(lambda: zlib.decompressobj(31), raw)
        if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
            return "zlib", _members(zlib.decompressobj, raw)
        if raw[:3] == b"BZh":
            return "bzip2", _members(bz2.BZ2Decompressor, raw)
        if raw[:6] == b"\xfd7zXZ\x00":
            return "xz", _members(lzma.LZMADecompressor, raw)
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            return "zstd", zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(MAX_LAYER_BYTES + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return None
    return None


def _replaced(layer: _Layer, pattern: re.Pattern[str], decode: object, step: str) -> _Layer | None:
    """The whole layer with each match decoded; a match that decodes to None stays."""
    text, starts, ends, at = [], [], [], 0
    changed = False
    for m in pattern.finditer(layer.text):
        new = decode(m)  # type: ignore[operator]
        if new is None:
            continue
        changed = True
        for k in range(at, m.start()):
            a, b = layer.span(k, k + 1)
            starts.append(a)
            ends.append(b)
        text.append(layer.text[at : m.start()])
        for piece, i, j in new:
            a, b = layer.span(m.start() + i, m.start() + j)
            starts += [a] * len(piece)
            ends += [b] * len(piece)
            text.append(piece)
        at = m.end()
    if not changed:
        return None
    for k in range(at, len(layer.text)):
        a, b = layer.span(k, k + 1)
        starts.append(a)
        ends.append(b)
    text.append(layer.text[at:])
    return _Layer("".join(text), starts, ends, (*layer.path, step))


def _url(m: re.Match[str]) -> list[tuple[str, int, int]]:
    """A byte that isn't UTF-8 is a character of its own, so one of them hides nothing of the others."""
    out, at = [], 0
    for ch in _text_of(bytes.fromhex(m.group().replace("%", ""))):
        n = len(ch.encode("utf-8", "surrogateescape"))
        out.append((ch, 3 * at, 3 * (at + n)))
        at += n
    return out


def _escape(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
    braced, high, low, four, eight, two = m.groups()
    code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00 if high else int(braced or four or eight or two, 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, m.end() - m.start())]


def _wide(m: re.Match[str]) -> list[tuple[str, int, int]]:
    text = m.group()
    return [(ch, 2 * k, 2 * k + 2) for k, ch in enumerate(text[1 if text[0] == "\0" else 0 :: 2])]


class _Run(NamedTuple):
    """What a base64 run decodes to. ``places`` are its characters' in the layer; a span within plain content is that of its groups of four."""

    layer: _Layer
    start: int
    end: int
    path: tuple[str, ...]
    content: str | None  # None: it is too large
    places: Sequence[int] | None  # None: compressed, so every span within is the whole run's

    def whole(self) -> tuple[int, int]:
        return self.layer.span(self.start, self.end)

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.places is None or self.content is None:
            return self.whole()
        if not self.content.isascii():
            a, b = (len(self.content[:x].encode("utf-8", "surrogateescape")) for x in (a, b))
        first, last = a // 3 * 4, -(-b // 3) * 4
        return self.layer.span(self.places[first], self.end if last >= len(self.places) else self.places[last - 1] + 1)


def _runs(layer: _Layer) -> Iterator[_Run]:
    """Each base64 run of a layer from each of its first four characters: what stands before it may belong to the alphabet too."""
    for m in (*_BASE64.finditer(layer.text), *_WRAPPED.finditer(layer.text)):
        whole = m.group().rstrip("=")
        folds = [f.span() for f in _FOLD.finditer(whole)]
        places: Sequence[int] = range(m.start(), m.start() + len(whole))
        if folds:
            cuts = [0, *(x for f in folds for x in f), len(whole)]
            places = [m.start() + k for a, b in zip(cuts[::2], cuts[1::2]) for k in range(a, b)]
        run = _FOLD.sub("", whole).translate(_STANDARD)
        for skip in range(4):
            size = len(run) - skip
            size -= size % 4 == 1
            if size < 2:
                continue
            content = base64.b64decode(run[skip : skip + size] + "=" * (-size % 4))
            path: tuple[str, ...] = (*layer.path, "base64")
            while inner := _inflate(content):
                kind, content = inner
                path = (*path, kind)
                if len(content) > MAX_LAYER_BYTES:
                    break
            plain = path[-1] == "base64"
            yield _Run(layer, places[skip], m.end(), path, None if len(content) > MAX_LAYER_BYTES else _text_of(content), places[skip:] if plain else None)


def _layers(text: str) -> Iterator[_Layer]:
    """The text and what its escapes and its UTF-16 stretches decode to, each text with the same spans once; all are shorter than where they come from."""
    work, seen = deque([_Layer(text, None, None, ())]), set()
    while work:
        layer = work.popleft()
        yield layer
        for pattern, decode, step in ((_URL, _url, "url"), (_ESCAPE, _escape, "unicode"), (_WIDE, _wide, "utf-16")):
            if new := _replaced(layer, pattern, decode, step):
                key = (new.text, hashlib.sha256(array("q", [*new.starts, *new.ends])).digest())  # type: ignore[misc]
                if key not in seen:
                    seen.add(key)
                    work.append(new)


_Secret = tuple[str, int, int, tuple[str, ...], str]  # rule, span, path, secret


class _Scanned(NamedTuple):
    own: list[_Secret]
    runs: list[_Run]


def _scan_content(text: str) -> _Scanned:
    """Secrets and decoded runs of one content, spans and paths counted from it. A run that decodes to the same content in several layers is taken in the first."""
    own, runs = [], []
    places: dict[str | None, list[tuple[int, int]]] = {}  # of each content, apart and in order
    for layer in _layers(text):
        for rule, pattern in RULES.items():
            for m in pattern.finditer(layer.text):
                group = next((g for g in range(1, (m.lastindex or 0) + 1) if m.group(g) is not None), 0)
                secret = m.group(group)
                if rule == "assigned-secret" and not (any(c.isdigit() for c in secret) and any(c.isalpha() for c in secret)):
                    continue
                own.append((rule, *layer.span(*m.span(group)), layer.path, secret))
        for run in _runs(layer):
            a, b = run.whole()
            there = places.setdefault(run.content, [])
            k = bisect_left(there, (a, b))
            if (k and there[k - 1][1] > a) or (k < len(there) and there[k][0] < b):
                continue
            there.insert(k, (a, b))
            runs.append(run)
    return _Scanned(own, runs)


def _compose(scanned: _Scanned, inside: dict[str, list[_Secret]]) -> list[_Secret]:
    """A content's own secrets and those inside its runs, each once at a span, where it is shallowest."""
    found: dict[tuple[str, int, int, str], _Secret] = {}
    for x in scanned.own:
        key = (x[0], x[1], x[2], x[4])
        if key not in found or len(x[3]) < len(found[key][3]):
            found[key] = x
    for run in scanned.runs:
        more: list[_Secret] = [("too-large-layer", 0, 0, (), "")] if run.content is None else inside.get(run.content, [])
        for rule, a, b, path, secret in more:
            at = run.span(a, b)
            key = (rule, *at, secret)
            if key not in found or len(run.path) + len(path) < len(found[key][3]):
                found[key] = (rule, *at, (*run.path, *path), secret)
    return list(found.values())


def scan_text(text: str) -> list[Finding]:
    """All secrets of a text and of its layers. The same secret of a rule at overlapping spans is given once, where it is shallowest.

    A worklist scans each different content once, however often it stands in another or in itself; then secrets are handed
    outwards, from the contents to the runs that decode to them, until no content has new ones.
    """
    scanned: dict[str, _Scanned] = {}
    work, order = deque([text]), []
    holders: dict[str, list[str]] = {}
    while work:
        content = work.popleft()
        if content in scanned:
            continue
        scanned[content] = _scan_content(content)
        order.append(content)
        for inner in {run.content for run in scanned[content].runs if run.content is not None}:
            holders.setdefault(inner, []).append(content)
            work.append(inner)
    inside: dict[str, list[_Secret]] = {}
    later, waiting = deque(reversed(order)), set(order)
    while later:
        content = later.popleft()
        waiting.discard(content)
        new = _compose(scanned[content], inside)
        if new and new != inside.get(content):
            inside[content] = new
            for holder in holders.get(content, []):
                if holder not in waiting:
                    waiting.add(holder)
                    later.append(holder)
    found: list[Finding] = []
    groups: dict[tuple[str, str], list[Finding]] = {}
    for rule, a, b, path, secret in inside.get(text, []):
        groups.setdefault((rule, secret), []).append(Finding(rule, a, b, len(path), ">".join(path), secret))
    for same in groups.values():
        kept: list[Finding] = []
        for f in sorted(same, key=lambda f: (f.depth, f.end - f.start, f.start)):
            k = bisect_left(kept, f.start, key=lambda g: g.start)
            if not (k and kept[k - 1].end > f.start) and not (k < len(kept) and kept[k].start < f.end):
                kept.insert(k, f)
        found += kept
    return sorted(found, key=lambda f: (f.start, f.end, f.rule, f.depth, f.secret))


def redact(text: str, findings: list[Finding]) -> str:
    """The text with each finding's span replaced by ``[rule]``; overlapping spans are replaced as one."""
    out, at, k = [], 0, 0
    while k < len(findings):
        start, end, rule = findings[k].start, findings[k].end, findings[k].rule
        while k + 1 < len(findings) and findings[k + 1].start < end:
            k += 1
            end = max(end, findings[k].end)
        out += [text[at:start], f"[{rule}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def _suspects(col: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, _HINT), False)).to_pylist()


FOUND = "doc_id bigint, rule string, start int, end int, depth int, path string, secret_sha256 string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for k in _suspects(batch.column(1)):
            doc = batch.column(0)[k].as_py()
            rows += [(doc, f.rule, f.start, f.end, f.depth, f.path, hashlib.sha256(f.secret.encode("utf-8", "surrogatepass")).hexdigest()) for f in scan_text(batch.column(1)[k].as_py())]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each secret in ``docs(doc_id, text)``: rule, span of the original text, depth and path of its layer.

    ``start`` and ``end`` count characters; ``secret_sha256`` identifies the secret without giving it away: all secrets of
    one decoded run share its span, each has its row. A null or
    empty text has none; a null doc_id stays null; repeated rows give repeated findings; other columns are ignored. A
    layer over ``MAX_LAYER_BYTES`` isn't held in memory but reported as rule ``too-large-layer``. Texts of any length are scanned
    whole; of overlapping matches of one secret by one rule the shallowest, then the narrowest, then the first is given; an empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_find, FOUND)


def _redact(batches: Iterator[pa.RecordBatch], text: int, size: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, new = batch.column(text), {}
        for k in _suspects(col):
            old = col[k].as_py()
            if found := scan_text(old):
                new[k] = redact(old, found)
        if new:
            cols = list(batch.columns)
            mask = pa.array([k in new for k in range(batch.num_rows)])
            cols[text] = pc.replace_with_mask(col, mask, pa.array([new[k] for k in sorted(new)], col.type))
            if size is not None:
                cols[size] = pc.replace_with_mask(cols[size], mask, pa.array([len(new[k]) for k in sorted(new)], cols[size].type))
            batch = pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        yield batch


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, each secret's span in ``text`` replaced by ``[rule]``, and ``n_chars``, if there, brought up to date.

    Overlapping spans are replaced as one, by the rule of the first. Null and empty texts, and rows with a null doc_id, stay as they
    are but for their secrets; repeated rows are each redacted, alike; all other columns, whatever their names, pass through; texts of
    any length are scanned whole; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    return docs.mapInArrow(partial(_redact, text=names.index("text"), size=names.index("n_chars") if "n_chars" in names else None), docs.schema)
