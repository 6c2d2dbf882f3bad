"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams of lengths 3 to 5, counted with a blank on either side, and itself; each hashes to one
of ``BUCKETS`` vectors. A word's vector is its subwords' mean, a text's the mean of its words', and a softmax over
it gives P(toxic). Vectors and softmax are fitted together (Adam over all rows, sparse) on at most
``MAX_TRAIN_ROWS`` labelled documents, those with the smallest hash of doc_id. A misspelling that was never seen shares most subwords with the word it
is made from, so it scores like it.

All but the softmax is linear, so each bucket's share of the log odds is one number; texts are scored by adding
those over the Arrow byte buffers, every position of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm import _text
from stemmata.session import prepare

MAX_TRAIN_ROWS, BITS, DIM = 5000, 17, 8
LENGTHS = (3, 4, 5)
THRESHOLD = 0.5
SEEN, POWER = 10, 2


class Model(NamedTuple):
    """Log odds of toxic: ``bias`` plus the mean over words of the mean of ``share`` over a word's subwords."""

    share: np.ndarray
    bias: float


def _slots(h: np.ndarray, length: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * length)) >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a few texts: (slots, first slot of each word (n + 1), the words' hashes)."""
    w = _text.words(col)
    hashes, one = np.unique(w.hashes, return_index=True)
    # the words one after another in one buffer, each with its two blanks
    size = w.ends[one] - w.starts[one] + 2
    first = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(first, size)
    raw = w.buf[np.repeat(w.starts[one] - 1, size) + within].copy()
    raw[first] = raw[first + size - 1] = 32
    c, q = _text.prefix(raw)
    word, slots = [np.arange(len(one))], [_slots(hashes, 0)]
    for n in LENGTHS:
        count = np.maximum(size - n + 1, 0)
        i = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        word.append(np.repeat(np.arange(len(one)), count))
        slots.append(_slots((c[i + n] - c[i]) * q[i], n))
    owner = np.concatenate(word)
    return np.concatenate(slots)[np.argsort(owner, kind="stable")], np.append(0, np.cumsum(np.bincount(owner, minlength=len(one)))), hashes


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value): the slot's share in the mean over the text's words of their subwords' means."""
    col = pa.array(texts, pa.string())
    w = _text.words(col)
    count = np.diff(w.first)
    slots, begin, vocabulary = subwords(col)
    word = np.searchsorted(vocabulary, w.hashes)
    pair, n = np.unique(np.repeat(np.arange(len(texts)), count) * np.int64(max(1, len(vocabulary))) + word, return_counts=True)
    doc, word = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
    width = np.diff(begin)[word]
    at = np.repeat(begin[word] - np.cumsum(width) + width, width) + np.arange(width.sum())
    cell, back = np.unique(np.repeat(doc, width) << BITS | slots[at], return_inverse=True)
    return cell >> BITS, cell & (1 << BITS) - 1, np.bincount(back, np.repeat(n / count[doc] / width, width))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each text, slot, value) of all texts, in order of text."""
    size, slots, values = np.zeros(len(texts), np.int64), [], []
    for a in range(0, len(texts), 250):
        doc, slot, value = _cells(texts[a : a + 250])
        size[a : a + 250] = np.bincount(doc, minlength=len(texts[a : a + 250]))
        slots.append(slot.astype(np.int32))
        values.append(value.astype(np.float32))
    return size, np.concatenate(slots), np.concatenate(values)


def fit(texts: list[str], y: np.ndarray, steps: int = 80, rate: float = 0.04, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on whole texts, a vector for every bucket that occurs; with no rows, no words or one class nothing is toxic.

    A bucket's input is scaled by its inverse deviation and by the ``POWER`` of its correlation with the class, as a share of the
    highest, less where fewer than about ``SEEN`` texts hold it: so weight decay bears most on what goes with neither
    class, wrong labels aren't learnt by heart, and no bucket is left out.
    """
    y = np.asarray(y, np.float64)
    nothing = Model(np.zeros(1 << BITS, np.float32), -20.0)
    if not len(y) or not 0 < y.sum() < len(y):
        return nothing
    size, slot, value = _sparse(texts)
    if not len(slot):
        return nothing
    # by bucket: the texts that hold it, and their values
    used, count = np.unique(slot, return_counts=True)
    order = np.argsort(slot, kind="stable")
    text = np.repeat(np.arange(len(y), dtype=np.int32), size)[order]
    by_slot = value[order]
    del order
    begin = np.cumsum(count) - count
    n = len(y)
    mean = np.add.reduceat(by_slot, begin, dtype=np.float64) / n
    deviation = np.sqrt(np.maximum(np.add.reduceat(by_slot * by_slot, begin, dtype=np.float64) / n - mean * mean, 0))
    along = np.abs(np.add.reduceat(by_slot * (y - y.mean()).astype(np.float32)[text], begin, dtype=np.float64)) / n
    sure = np.where(deviation > 1e-12, along / np.maximum(deviation, 1e-12), 0) * count / (count + SEEN)
    scale = (sure / max(sure.max(), 1e-300)) ** POWER / np.maximum(deviation, 1e-12)
    by_slot *= np.repeat(scale.astype(np.float32), count)
    place = np.searchsorted(used, slot).astype(np.int32)
    by_text = value * scale.astype(np.float32)[place]
    del slot, value
    some = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[some]
    # logits differ by x e (h1 - h0), so both gradients are products of one number for each text and the sparse input
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)) / np.sqrt(len(used)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        e, head, bias = params
        across = head[:, 1] - head[:, 0]
        z = np.full(n, bias[1] - bias[0])
        z[some] += np.add.reduceat(by_text * (e @ across).astype(np.float32)[place], first)
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.add.reduceat(by_slot * d.astype(np.float32)[text], begin).astype(np.float64)
        up = e.T @ g
        grads = [np.outer(g, across) + decay * e, np.stack([-up, up], 1) + decay * head, np.array([-d.sum(), d.sum()])]
        for p_, g_, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g_ - m)
            v += 0.001 * (g_ * g_ - v)
            p_ -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    e, head, bias = params
    out = np.zeros(1 << BITS, np.float32)
    out[used] = (e @ (head[:, 1] - head[:, 0])) * scale
    return Model(out, float(bias[1] - bias[0]))


def log_odds(col: pa.Array, model: Model) -> np.ndarray:
    """Of each text; of one without words the bias alone counts as minus infinity."""
    w = _text.words(col)
    count = np.diff(w.first)
    total, n = np.zeros(len(w.starts), np.float64), np.ones(len(w.starts), np.float64)
    total += model.share[_slots(w.hashes, 0)]
    plain = np.where(_text.IS_WORD[w.buf], w.buf, 32)
    at = 0
    while at < len(w.starts):
        base = w.starts[at] - 1
        to = max(at + 1, int(np.searchsorted(w.ends, base + _text.PIECE, "right")))
        raw = plain[base : w.ends[to - 1] + 1]
        c, q = _text.prefix(raw)
        i, j = w.starts[at:to] - 1 - base, w.ends[at:to] + 1 - base
        for length in LENGTHS:
            if len(raw) >= length:
                s = np.zeros(len(raw) - length + 2, np.float64)
                np.cumsum(model.share[_slots((c[length:] - c[:-length]) * q[: len(raw) - length + 1], length)], out=s[1:])
                i_ = np.minimum(i, len(s) - 1)  # a word too short for this length may begin after the last n-gram
                end = np.maximum(j - length + 1, i_)
                total[at:to] += s[end] - s[i_]
                n[at:to] += end - i_
        at = to
    doc = np.repeat(np.arange(len(count)), count)
    mean = np.bincount(doc, total / n, len(count)) / np.maximum(count, 1)
    return np.where(count > 0, mean + model.bias, -np.inf)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hash of doc_id, texts whole, in order of id and text.

    Labels other than 0 and 1 and null ids are left out; of repeated labels the toxic one counts.
    """
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows["text"].to_pylist(), rows["y"].to_numpy())


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = np.concatenate([log_odds(col, model) for _, col in _text.chunks(batch.column(1))] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "toxicity"])


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, is_toxic) of each row of ``docs(doc_id, text)``.

    A null text, or one without words, scores 0; a null doc_id stays null; repeated rows are each scored, alike. A score equal to
    the threshold is toxic. Texts of any length are scored whole; an empty table gives an empty result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_score, model=model), "doc_id bigint, toxicity double")
    return scored.withColumn("is_toxic", F.col("toxicity") >= threshold)
