"""License scans: a trained paragraph classifier names the licence family, and a template comparison confirms it.

A paragraph is a line with the lines that continue it: a line of the length of folded text (``WRAP``) that ends in no mark goes on in the
next one that has a word, so a licence folded into lines is read in sentences or more, and a notice on a line of its own by itself.
Its features are the word n-grams of lengths 1 to ``GRAMS`` that occur in the templates, present or
not: a sparse row. A softmax regression over them has a class for each family and one for everything else. It is
fitted on the driver from ``license_texts``: whole paragraphs and notices, cut, disturbed and set among other words, and paragraphs
that only look like licences; nothing is read from the corpus. A temperature, fitted on notices in other words and other look-alikes, which
training doesn't see, calibrates its probabilities; a family needs ``THRESHOLD``, else the paragraph is unknown.

Paragraphs that hold none of the features can only be unknown, so the work is a hash lookup of every n-gram of an Arrow
batch at once, and sums over the few that hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm import _text
from stemmata.llm.license_texts import HELD_OUT, HELD_OUT_LOOKALIKES, LOOKALIKES, TEMPLATES
from stemmata.session import prepare

GRAMS, THRESHOLD, CONFIRM, PART, TRAIN_ROWS, SEED = 3, 0.5, 0.6, 8, 4500, 11
WRAP = (40, 120, 5)  # of a line that the next one continues: least and most bytes, least blanks
FILLER = "a man went home by train before noon while rain fell on old houses near water and people sang songs about long roads they never knew each day some more would come again with small bright things from far away towns where time stood still until morning light came over hills".split()
FOUND = "doc_id bigint, paragraph int, start int, end int, family string, probability double, template string, similarity double, confirmed boolean"


class Model(NamedTuple):
    """``terms`` are sorted hashes of n-grams; a row of ``weights`` for each; the last class is unknown."""

    families: list[str]
    terms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that begin at each place."""
    h = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : len(hashes) - n + 1 + k]
    return _text.mix(h + np.uint64(n))


def _features(texts: list[str]) -> list[np.ndarray]:
    """Of each text the distinct hashes of all its n-grams."""
    w = _text.words(pa.array(texts, pa.string()))
    return [np.unique(np.concatenate([_grams(w.hashes[a:b], n) for n in range(1, GRAMS + 1) if b - a >= n] or [np.zeros(0, np.uint64)])) for a, b in zip(w.first[:-1], w.first[1:])]


def examples(seed: int, rows: int, templates: dict[str, list[str]] | None = None, lookalikes: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Whole, broken and disturbed templates and other paragraphs, some among other words, with their classes (numbered as ``TEMPLATES``)."""
    rng = np.random.default_rng(seed)
    templates, lookalikes = templates or TEMPLATES, lookalikes or LOOKALIKES
    families = list(TEMPLATES)
    vocabulary = sorted({x for ts in TEMPLATES.values() for t in ts for x in t.split()})
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    texts, y = [], []
    for k in range(rows):
        if k % 3:
            own = pick(sorted(templates))
            family, tokens = families.index(own), pick(templates[own]).split()
            if len(tokens) > 16 and rng.random() < 0.5:  # some lines of a longer paragraph
                n = int(rng.integers(8, len(tokens)))
                at = int(rng.integers(0, len(tokens) - n + 1))
                tokens = tokens[at : at + n]
            if len(tokens) > 4 and rng.random() < 0.5:  # one word is missing or wrong, or one in six
                for at in sorted({int(rng.integers(len(tokens))) for _ in range(1 if rng.random() < 0.5 else len(tokens) // 6 + 1)}, reverse=True):
                    tokens[at : at + 1] = [] if rng.random() < 0.5 else [pick(FILLER)]
            if rng.random() < 0.3:  # its tail may be missing
                tokens = tokens[: max(4, int(len(tokens) * rng.uniform(0.7, 1)))]
        else:
            family, kind = len(families), rng.random()
            if kind < 0.4:
                tokens = pick(lookalikes).split()
            elif kind < 0.7:  # the templates' words without their order, few or nearly all
                tokens = [pick(vocabulary) for _ in range(int(np.exp(rng.uniform(0, 7))))]
            else:
                tokens = [pick(FILLER) for _ in range(int(rng.integers(0, 60)))]
        around = lambda: [pick(FILLER) if rng.random() < 0.8 else pick(pick(lookalikes).split()) for _ in range(int(rng.integers(0, 25)))]
        if rng.random() < 0.5:
            tokens = [*around(), *tokens, *around()]
        texts.append(" ".join(tokens))
        y.append(family)
    return texts, np.array(y)


def _rows(found: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    x = np.zeros((len(found), len(terms)), np.float32)
    for k, f in enumerate(found):
        at = np.minimum(np.searchsorted(terms, f), len(terms) - 1)
        x[k, at[terms[at] == f]] = 1
    return x


@lru_cache(1)
def train(rows: int = TRAIN_ROWS, steps: int = 120, rate: float = 0.05, decay: float = 3e-4) -> Model:
    """The classifier of ``TEMPLATES``; its temperature is the likeliest on ``HELD_OUT`` notices and look-alikes that training didn't see."""
    terms = np.unique(np.concatenate(_features([t for ts in TEMPLATES.values() for t in ts])))
    texts, y = examples(SEED, rows)
    x, hot = _rows(_features(texts), terms), np.eye(len(TEMPLATES) + 1, dtype=np.float32)[y]
    params = [np.zeros((len(terms), hot.shape[1]), np.float32), np.zeros(hot.shape[1], np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        z = x @ params[0] + params[1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hot) / len(x)
        for q, g, (m, v) in zip(params, (x.T @ d + decay * params[0], d.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(list(TEMPLATES), terms, params[0].astype(np.float64), params[1].astype(np.float64), 1.0)
    held, truth = examples(SEED + 1, rows // 3, HELD_OUT, HELD_OUT_LOOKALIKES)
    logits = _rows(_features(held), terms) @ model.weights + model.bias
    grid = np.geomspace(0.25, 4, 33)
    loss = [-np.log(np.maximum(model._replace(temperature=t).probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return model._replace(temperature=float(grid[int(np.argmin(loss))]))


def _shares(text: str, templates: list[str]) -> list[float]:
    """Of each template the share of its word 3-grams (all its words, if fewer) that the text holds or, of a text of ``PART`` words or more, that of the text's in it."""
    w = _text.words(pa.array([text, *templates], pa.string()))
    cut = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    out = []
    for t in cut[1:]:
        n = min(GRAMS, len(t))
        theirs, ours = np.unique(_grams(t, n)), np.unique(_grams(cut[0], n)) if len(cut[0]) >= n else cut[0][:0]
        both = len(np.intersect1d(theirs, ours))
        out.append(max(both / len(theirs), both / len(ours) if len(cut[0]) >= PART else 0.0))
    return out


def confirm(text: str, family: str) -> tuple[str, float]:
    """The family's template that is most like a paragraph, and how much of either the other holds."""
    shares = _shares(text, TEMPLATES[family])
    best = int(np.argmax(shares))
    return TEMPLATES[family][best], shares[best]


def _continued(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each line feed of some texts whether the line before it goes on in the next: as long as a folded line, without a mark at its end."""
    feeds = np.flatnonzero(buf == 10)
    doc = np.searchsorted(off, feeds, "right") - 1
    inner = np.append(False, doc[1:] == doc[:-1])[: len(feeds)]
    start = np.where(inner, np.append(0, feeds[:-1] + 1)[: len(feeds)], off[doc])
    following = np.where(np.append(inner[1:], False)[: len(feeds)], np.append(feeds[1:], 0)[: len(feeds)], off[doc + 1])
    sums = lambda which: np.append(0, np.cumsum(which))
    word, blank = sums(_text.IS_WORD[buf]), sums(buf == 32)
    end = feeds - ((feeds > start) & (buf[feeds - 1] == 13))
    last = np.where(end > start, buf[np.maximum(end - 1, 0)], 32)
    size = end - start
    return (size >= WRAP[0]) & (size <= WRAP[1]) & ~np.isin(last, list(b".!?:;")) & (blank[end] - blank[start] >= WRAP[2]) & (word[end] > word[start]) & (word[following] > word[feeds])


def paragraphs(text: str) -> list[tuple[int, int]]:
    """The spans of a text's paragraphs: each line, with the lines that continue it."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    on = _continued(raw, np.array([0, len(raw)])).tolist()
    out, at, start = [], 0, 0
    for line, more in zip(text.split("\n"), [*on, False]):
        at += len(line)
        if not more:
            out.append((start, at))
            start = at + 1
        at += 1
    return out


def _scan(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    maybe = np.zeros(1 << 20, bool)
    maybe[model.terms >> np.uint64(44)] = True
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_()]
    for batch in batches:
        out: list[tuple] = []
        for at, col in _text.chunks(batch.column(1)):
            w = _text.words(col)
            if not len(w.hashes):
                continue
            doc = np.repeat(np.arange(len(col)), np.diff(w.first))
            # paragraphs are numbered through the chunk: a new one at each line feed that nothing continues, and at each text
            breaks = np.append(0, np.cumsum(~_continued(*_text.buffer(col))))
            paragraph = breaks[np.searchsorted(np.flatnonzero(w.buf == 10), w.starts)] + doc
            places, features = [], []
            for n in range(1, GRAMS + 1):
                if len(w.hashes) < n:
                    break
                h = _grams(w.hashes, n)
                k = np.flatnonzero(maybe[h >> np.uint64(44)] & (paragraph[n - 1 :] == paragraph[: len(h)]))
                f = np.minimum(np.searchsorted(model.terms, h[k]), len(model.terms) - 1)
                hit = model.terms[f] == h[k]
                places.append(k[hit])
                features.append(f[hit])
            k, f = np.concatenate(places), np.concatenate(features)
            if not len(k):
                continue
            cell, one = np.unique(paragraph[k].astype(np.int64) * len(model.terms) + f, return_index=True)
            own, k, f = cell // len(model.terms), k[one], f[one]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            logits = np.add.reduceat(model.weights[f], new, axis=0) + model.bias
            p = model.probabilities(logits)
            best = np.argmax(p[:, :-1], axis=1)
            sure = p[np.arange(len(p)), best]
            feeds = np.cumsum(np.append(0, pc.count_substring(pc.fill_null(col, ""), "\n").to_numpy(zero_copy_only=False)))
            now, spans = -1, []
            for j in np.flatnonzero(sure >= threshold):
                d = int(doc[k[new[j]]])
                if d != now:
                    now, text = d, col[d].as_py()
                    spans = paragraphs(text)
                number = int(own[new[j]] - d - breaks[feeds[d]])
                family, (a, b) = model.families[best[j]], spans[number]
                template, share = confirm(text[a:b], family)
                out.append((batch.column(0)[at + d].as_py(), number, a, b, family, round(float(sure[j]), 6), template, round(share, 6), share >= CONFIRM))
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in FOUND.split(", ")])


def scan(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each paragraph of ``docs(doc_id, text)`` whose licence family is known.

    ``paragraph`` counts from 0, ``start`` and ``end`` are its characters; ``similarity`` is the share of
    ``template`` that the paragraph holds (or of the paragraph in it), ``confirmed`` says that it reaches ``CONFIRM``. Null and empty texts, and
    texts without a word, give nothing; a null doc_id stays null; repeated rows give repeated findings; texts of any length are read whole; an
    empty table gives an empty result; other columns are ignored. Of families that are equally likely the first of ``TEMPLATES`` is named.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_scan, model=model or train(), threshold=threshold), FOUND)
