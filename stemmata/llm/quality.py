"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, counted on the Arrow byte buffers. Trees are fitted on the driver from at most
``MAX_TRAIN_ROWS`` labelled documents (those with the smallest hash of doc_id), flattened into arrays, and walked
by all rows and all trees of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm import _text
from stemmata.llm.gbt import Trees, fit
from stemmata.session import prepare

MAX_TRAIN_ROWS = 10_000
THRESHOLD = 0.3  # a document is dropped only where the evidence is clear
STATISTICS = ["log_words", "word_length", "long_words", "upper", "digit", "blank", "line", "mark", "symbol", "wide", "distinct", "most_common", "adjacent", "distinct_pairs"]
_CLASS = np.zeros(256, np.uint8)  # 0 lower case and the rest
for _k, _set in enumerate((range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), b".,;:'\"()?-", b"!#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASS[list(_set)] = _k


def statistics(col: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; all 0 for a null or empty one."""
    w = _text.words(col, lower=False)
    n = len(w.first) - 1
    out = np.zeros((n, len(STATISTICS)))
    buf, off = _text.buffer(col)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    size = np.maximum(np.diff(off), 1)
    kind = _CLASS[buf]
    for k in range(1, 8):
        own = kind == k
        out[:, 2 + k] = [np.count_nonzero(own[a:b]) for a, b in zip(off[:-1], off[1:])]
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    lengths = w.ends - w.starts
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(doc, lengths, n) / some
    out[:, 2] = np.bincount(doc, lengths > 12, n) / some
    out[:, 3:10] /= size[:, None]

    def distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort((h & np.uint64(0xFFFFFFFFFFFF)) | (of.astype(np.uint64) << np.uint64(48)))
        new = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
        runs = np.diff(np.append(new, len(key)))
        owner = (key[new] >> np.uint64(48)).astype(np.int64)
        own = np.bincount(owner, minlength=n)
        most, some_ = np.zeros(n), own > 0
        if len(runs):
            most[some_] = np.maximum.reduceat(runs, (np.cumsum(own) - own)[some_])
        return own, most

    # 16 bits hold the text's place in the chunk: ``chunks`` takes no more texts
    if n > 1 << 16:
        raise ValueError(f"{n} texts at once; at most {1 << 16}")
    kinds_of_words, most = distinct(w.hashes, doc)
    out[:, 10], out[:, 11] = kinds_of_words / some, most / some
    if len(doc) > 1:
        inside = doc[1:] == doc[:-1]
        a, b, of = w.hashes[:-1][inside], w.hashes[1:][inside], doc[1:][inside]
        pairs = np.maximum(count - 1, 1)
        out[:, 12] = np.bincount(of, a == b, n) / pairs
        out[:, 13] = distinct(_text.mix(a * np.uint64(0x9E3779B97F4A7C15) + b), of)[0] / pairs
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, col in _text.chunks(batch.column(2)):
            x = statistics(col)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), batch.column(1).slice(at, len(col)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    """Fit P(quality = 1) on at most ``max_rows`` labelled documents; without any, every document is good.

    Labels other than 0 and 1 and null ids are left out; of repeated labels the poorer one counts. Rows are taken in order of doc_id and
    statistics, so the model doesn't depend on how the tables are stored.
    """
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(_features, "doc_id bigint, y int, x binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, rows["y"].to_numpy().astype(np.float64))


def _score(batches: Iterator[pa.RecordBatch], model: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.concatenate([model.probability(statistics(col)) for _, col in _text.chunks(batch.column(batch.num_columns - 1))] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(p)], [*batch.schema.names[:-1], "quality_score"])


def classify(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality_score, is_good) of each row of ``docs(doc_id, text)``.

    A null or empty text has all statistics 0 and gets the score of that; a null doc_id stays null; repeated rows
    are each scored, alike. A score equal to the threshold is good. Texts of any length are counted whole; an empty table gives an empty
    result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_score, model=model), "doc_id bigint, quality_score double")
    return scored.withColumn("is_good", F.col("quality_score") >= threshold)


def _filter(batches: Iterator[pa.RecordBatch], model: Trees, threshold: float, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.concatenate([model.probability(statistics(col)) for _, col in _text.chunks(batch.column(text))] or [np.zeros(0)])
        yield batch.filter(pa.array((p >= threshold) | batch.column(text).is_null().to_numpy(zero_copy_only=False)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold`` (equal to it is enough), all columns as they were, whatever their names.

    Null texts stay, unjudged; empty ones are judged by statistics that are all 0; rows with a null doc_id are judged like any; repeated
    rows share a fate; texts of any length are counted whole; an empty table stays empty, and without labels all rows stay.
    """
    model = train(docs, labels, max_rows)
    return docs.mapInArrow(partial(_filter, model=model, threshold=threshold, text=docs.columns.index("text")), docs.schema)
