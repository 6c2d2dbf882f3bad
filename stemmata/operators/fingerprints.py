"""Fingerprints of passages as rows of an inverted index, made in the task that cuts the passages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions import fingerprint as fp
from stemmata.functions import tokenize as tk
from stemmata.operators.atoms import by_repeats, documents

HASHES = "doc_id bigint, atom_num int, hash_value bigint"
GRAMS = "doc_id bigint, atom_num int, gram string"


def _prints(batches: Iterator[pa.RecordBatch], atom: str, size: int, method: str, n: int, k: int, span: int, strings: bool) -> Iterator[pa.RecordBatch]:
    name, kind = ("gram", pa.string()) if strings else ("hash_value", pa.int64())
    for batch in batches:
        docs, nums, values = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(nums, pa.int32()), pa.array(values, kind)], ["doc_id", "atom_num", name])
            docs.clear(), nums.clear(), values.clear()
            return out

        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for num, (a, b) in enumerate(tk.tokenize(text, atom, size)):
                own = fp.grams(text[a:b], method, n, k) if strings else fp.fingerprint(text[a:b], method, n, k, span)
                docs += [doc] * len(own)
                nums += [num] * len(own)
                values += own
            if len(values) > 1 << 17:
                yield flush()
        yield flush()


def fingerprints(docs: DataFrame, method: str, n: int, k: int = 0, atom: str = "full", size: int = 5000, span: int = fp.SPAN) -> DataFrame:
    """(doc_id, atom_num, hash_value): the distinct hashes of each passage."""
    fp.fingerprint("", method, n, k)
    return documents(docs).mapInArrow(partial(_prints, atom=atom, size=size, method=method, n=n, k=k, span=span, strings=False), HASHES)


def chosen_grams(docs: DataFrame, method: str, n: int, k: int = 0, atom: str = "full", size: int = 5000) -> DataFrame:
    """(doc_id, atom_num, gram): the word n-grams before they are hashed."""
    fp.grams("", method, n, k)
    return documents(docs).mapInArrow(partial(_prints, atom=atom, size=size, method=method, n=n, k=k, span=0, strings=True), GRAMS)


def _gram_counts(batches: Iterator[pa.RecordBatch], method: str, n: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter[str] = Counter()
        docs: Counter[str] = Counter()
        for text in batch.column(1).to_pylist():
            own = fp.grams(text, method, n, k)
            total.update(own)
            docs.update(set(own))
            if len(total) > 1 << 18:
                yield _counted(total, docs)
                total.clear(), docs.clear()
        yield _counted(total, docs)


def _counted(total: Counter[str], docs: Counter[str]) -> pa.RecordBatch:
    grams = list(total)
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([total[g] for g in grams], pa.int64()), pa.array([docs[g] for g in grams], pa.int64())], ["gram", "n", "docs"])


def gram_counts(docs: DataFrame, method: str, n: int, k: int = 0) -> DataFrame:
    """(gram, n, docs): how often each chosen n-gram of whole texts occurs, and in how many documents; rows that repeat an id are one document.

    Counted in the task that reads the texts, so one shuffle of counts by gram is all; only repeated ids are counted by (gram, doc_id) first.
    """
    fp.grams("", method, n, k)
    alone, again = by_repeats(docs)
    counts = alone.mapInArrow(partial(_gram_counts, method=method, n=n, k=k), "gram string, n bigint, docs bigint")
    if again is not None:
        per = chosen_grams(again, method, n, k).groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
        counts = counts.unionByName(per.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
    return counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _digrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(27 * 27, np.int64)
    place = np.full(256, 26, np.int64)
    place[97:123] = np.arange(26)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = place[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
            total += np.bincount(c[:-1] * 27 + c[1:], minlength=27 * 27)
    at = [k for k in np.flatnonzero(total).tolist() if k // 27 < 26 and k % 27 < 26]
    yield pa.RecordBatch.from_arrays([pa.array([chr(97 + k // 27) + chr(97 + k % 27) for k in at], pa.string()), pa.array(total[at])], ["digram", "n"])


def digrams(docs: DataFrame) -> DataFrame:
    """(digram, n): how often two lower-case letters follow each other; each task sends 676 sums at most."""
    return documents(docs).select("text").mapInArrow(_digrams, "digram string, n bigint").groupBy("digram").agg(F.sum("n").alias("n"))


def anchors(docs: DataFrame, count: int = 10, skip: float = 0.15) -> DataFrame:
    """(rank, digram, n): ``count`` anchors from the place ``skip`` down the list of digrams by frequency."""
    ranked = digrams(docs).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "digram"))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    first = F.floor(F.col("_all") * skip)
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= first + count)).select("rank", "digram", "n")


def around_anchor(docs: DataFrame, anchor: str, n: int) -> DataFrame:
    """(doc_id, gram): words around each word that holds ``anchor``, found by a regular expression in the JVM."""
    before, after = (n - 1) // 2, n // 2
    pattern = rf"(?:\w+\W+){{0,{before}}}\w*{anchor}\w*(?:\W+\w+){{0,{after}}}"
    return documents(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("gram"))
