"""Tokenizers as table functions: documents to rows of spans, in one pass over Arrow batches and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.functions import tokenize as tk
from stemmata.session import BROADCAST_BYTES, Scratch, prepare, small

ROWS = 1 << 16
SIDE_BY_SIDE = 4 << 20  # characters of one id that a task may hold
ATOM = "doc_id bigint, atom_num int, start int, end int, text string"
UNIT = "doc_id bigint, atom_num int, via_num int, unit_num int, start int, end int, text string"


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): without nulls, and without a byte-order mark at the start of a text."""
    prepare(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_replace("text", "^\ufeff", "").alias("text"))


def _repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The documents, and the ids that several of them have, with their number."""
    d = documents(docs)
    again = Scratch(docs.sparkSession, "repeats").keep(d.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "table")
    return d, again, again.count()


def by_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents whose id no other row has, and those whose id is repeated, whose hashes count together; None if there are none."""
    d, again, rows = _repeated(docs)
    if not rows:
        return d, None
    again = small(again, rows, 40)
    return d.join(again, "doc_id", "left_anti"), d.join(again, "doc_id", "left_semi")


def side_by_side(docs: DataFrame, most: int = SIDE_BY_SIDE) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """As ``by_repeats``, but the rows of a repeated id follow each other in one task: their texts are shuffled once, not their hashes.

    Third are the rows of ids with over ``most`` characters in all, which no task should hold. Where the repeated ids are too many for a
    broadcast, the second has all other rows and the first none. None where there are none.
    """
    d, again, rows = _repeated(docs)
    if not rows:
        return d, None, None
    sizes = d.groupBy("doc_id").agg(F.count("*").alias("_n"), F.sum(F.length("text").cast("bigint")).alias("_chars")).where(f"_n > 1 AND _chars > {most}")
    large = Scratch(docs.sparkSession, "large").keep(sizes.select("doc_id"), "table")
    count, vast = large.count(), None
    if count:
        large = small(large, count, 40)
        d, vast = d.join(large, "doc_id", "left_anti"), d.join(large, "doc_id", "left_semi")
    alone, together = None, d
    if rows * 40 <= BROADCAST_BYTES:
        alone, together = (d.join(F.broadcast(again), "doc_id", how) for how in ("left_anti", "left_semi"))
    # by a hash of the id: a shuffle by the id itself could be left out after a join, whose skewed partitions may be split
    return alone, together.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id"), vast


def _emit(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _atoms(batches: Iterator[pa.RecordBatch], kind: str, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(doc, k, a, b, text[a:b]) for k, (a, b) in enumerate(tk.tokenize(text, kind, n))]
            if len(rows) > ROWS:
                yield _emit(rows, ATOM)
                rows = []
        yield _emit(rows, ATOM)


def atoms(docs: DataFrame, kind: str, n: int = 5000) -> DataFrame:
    """(doc_id, atom_num, start, end, text) for each span of ``kind``: word, sentence, paragraph, line, nchars, full."""
    tk.tokenize("", kind, n)
    return documents(docs).mapInArrow(partial(_atoms, kind=kind, n=n), ATOM)


def nchars_spans(length: Column, n: int) -> Column:
    """The spans of ``nchars`` as an array expression, for plans that need no text."""
    count = F.greatest(F.lit(1), F.floor(length / n).cast("int"))
    last = lambda k: k == count - 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("atom_num"), (k * n).alias("start"), F.when(last(k), length).otherwise((k + 1) * n).alias("end")))


def _range(starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Which of some ordered spans overlap [a, b)."""
    return int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))


def _units(batches: Iterator[pa.RecordBatch], kind: str, n: int, via: str | None, unit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = tk.tokenize(text, unit, n)
            us, ue = np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64)
            pieces = [text[a:b] for a, b in spans]
            outer = tk.tokenize(text, via, n) if via else []
            vs, ve = np.array([s for s, _ in outer], np.int64), np.array([e for _, e in outer], np.int64)
            for k, (a, b) in enumerate(tk.tokenize(text, kind, n)):
                for v, (c, d) in [(v, outer[v]) for v in range(*_range(vs, ve, a, b))] if via else [(0, (a, b))]:
                    rows += [(doc, k, v, u, *spans[u], pieces[u]) for u in range(*_range(us, ue, c, d))]
                if len(rows) > ROWS:
                    yield _emit(rows, UNIT)
                    rows = []
        yield _emit(rows, UNIT)


def units(docs: DataFrame, kind: str, unit: str, via: str | None = None, n: int = 5000) -> DataFrame:
    """The ``unit`` spans that each atom of ``kind`` touches: (doc_id, atom_num, via_num, unit_num, start, end, text).

    With ``via`` an atom first grows to all of the ``via`` spans that it touches; ``via_num`` says in which one a unit
    lies. A unit across a border belongs to both atoms.
    """
    return documents(docs).mapInArrow(partial(_units, kind=kind, n=n, via=via, unit=unit), UNIT)
