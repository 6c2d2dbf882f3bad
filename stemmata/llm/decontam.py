"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is split by document, as search engines shard it: each row is a *segment*, the postings of some whole
documents, holding every token of them: the sorted distinct term hashes, how often each occurs, and the token
positions grouped by term. All occurrences of a document are in one segment, so lists are intersected there and no
posting is ever shuffled. The segments are written once as a table and read by any number of searches.

A search takes the frequencies of the test terms over the whole corpus from the index, and then in each segment

* **phrase**: for each window of ``phrase`` tokens of an item (the whole item if it has fewer), starts from the
  postings of the window's rarest term less its offset, and intersects them with the other terms' offset-adjusted
  lists in order of rarity until nothing is left;
* **proximity**: finds alignments s at which at least ``ceil(ratio * L)`` of an item's L tokens occur within
  ``slack`` places of s + their offset. At most m = L - ceil(ratio * L) may fail, so of the m + 3 rarest 3 must be
  there: only their lists give candidates, which the other lists confirm. Nothing is missed.

The test set is handled ``item_batch_bytes`` at a time, so what a task holds of it does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm import _text
from stemmata.session import Scratch, prepare, without_ids

PHRASE, RATIO, SLACK, EXTRA = 13, 0.6, 3, 3
SEGMENT_BYTES = 4 << 20
SEGMENT = "doc_ids binary, first binary, terms binary, counts binary, places binary"
MATCH = "item_id bigint, doc_id bigint, kind string, start int, matched int, item_tokens int"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, col in _text.chunks(batch.column(1), SEGMENT_BYTES):
            w = _text.words(col)
            places = np.argsort(w.hashes, kind="stable").astype(np.uint32)
            ordered = w.hashes[places]
            new = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
            parts = [ids[at : at + len(col)], w.first.astype(np.uint32), ordered[new], np.diff(np.append(new, len(ordered))).astype(np.uint32), places]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["doc_ids", "first", "terms", "counts", "places"])


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of ``docs(doc_id, text)``. Rows whose doc_id or text is null have no postings; other columns are ignored."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_index, SEGMENT)


class _Items:
    """Test items as arrays: the distinct terms, and of each item its terms' indices."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = _text.words(pa.array(texts, pa.string()))
        self.vocabulary, place = np.unique(w.hashes, return_inverse=True)
        self.items = [(i, place[a:b]) for i, a, b in zip(ids, w.first[:-1], w.first[1:]) if b > a]

    def plan(self, frequency: np.ndarray, phrase: int, ratio: float) -> None:
        """Order the work by the terms' frequencies: of each window, and of each item, the rarest first."""
        self.windows, self.near = [], []
        for k, (_, terms) in enumerate(self.items):
            f, n, size = frequency[terms], min(phrase, len(terms)), len(terms)
            for a in range(size - n + 1):
                self.windows.append((k, a, n, a + np.argsort(f[a : a + n], kind="stable")))
            most_missing = size - int(np.ceil(ratio * size - 1e-9))
            rare = np.argsort(f, kind="stable")[: most_missing + EXTRA]
            self.near.append((rare, len(rare) - most_missing, size - most_missing))
        # all items' rarest terms one after another: which items can be near is seen for all at once
        sizes = [len(rare) for rare, _, _ in self.near]
        self.rare = np.concatenate([terms[rare] for (_, terms), (rare, _, _) in zip(self.items, self.near)])
        self.rare_from = np.cumsum(sizes) - sizes
        self.need = np.array([need for _, need, _ in self.near])
        self.anchor = np.array([self.items[k][1][order[0]] for k, _, _, order in self.windows], np.int64)


def _sums(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for terms, counts in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            t, c = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)
            if len(t):
                at = np.minimum(np.searchsorted(t, vocabulary), len(t) - 1)
                total += np.where(t[at] == vocabulary, c[at], 0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


class _Segment:
    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.docs, self.first = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["first"], np.uint32).astype(np.int64)
        terms, counts, self.places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["places"], np.uint32)
        ends = np.cumsum(counts, dtype=np.int64)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
            here = terms[at] == vocabulary
            self.end, self.size = np.where(here, ends[at], 0), np.where(here, counts[at], 0).astype(np.int64)
        else:
            self.end = self.size = np.zeros(len(vocabulary), np.int64)
        self.lists: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = self.places[self.end[term] - self.size[term] : self.end[term]].astype(np.int64)
        return self.lists[term]

    def doc_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def _phrases(seg: _Segment, items: _Items) -> dict[tuple[int, int], tuple[int, int]]:
    """(item, document) to (first place, length) of the longest run, the first of equals."""
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for k in np.flatnonzero(seg.size[items.anchor]):
        item, a, n, order = items.windows[k]
        terms = items.items[item][1]
        starts = seg.postings(terms[order[0]]) - order[0]
        for o in order[1:]:
            starts = starts[_among(seg.postings(terms[o]), starts + o)]
            if not len(starts):
                break
        if len(starts):
            d = seg.doc_at(starts + a)
            for s, x in zip(starts[same := d == seg.doc_at(starts + a + n - 1)], d[same]):
                runs.setdefault((item, x, s), []).append((s + a, s + a + n))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (item, x, _), spans in runs.items():
        spans.sort()
        merged = [list(spans[0])]
        for b, e in spans[1:]:
            if b <= merged[-1][1]:
                merged[-1][1] = e
            else:
                merged.append([b, e])
        for b, e in merged:
            old = best.get((item, x))
            if old is None or (old[0] - old[1], old[0]) > (b - e, b):
                best[item, x] = (b, e)
    return {key: (b, e - b) for key, (b, e) in best.items()}


def _near(seg: _Segment, items: _Items, slack: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(item, document) to (alignment, tokens found) with most tokens, the first of equals."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    there = np.add.reduceat((seg.size[items.rare] > 0).astype(np.int64), items.rare_from)
    for item in np.flatnonzero(there >= items.need).tolist():
        rare, need, least = items.near[item]
        terms = items.items[item][1]
        sizes = seg.size[terms[rare]]
        a = np.sort(np.concatenate([seg.postings(terms[o]) - o for o in rare[sizes > 0]]))
        if len(a) < need:
            continue
        head = np.unique(a[: len(a) - need + 1][a[need - 1 :] - a[: len(a) - need + 1] <= 2 * slack])
        if not len(head):
            continue
        align = np.unique((head[:, None] + np.arange(-slack, slack + 1)).ravel())
        # the documents that an alignment can lie in: the one of any place that it covers
        of, doc = [], []
        last = seg.doc_at(np.minimum(align + len(terms) - 1 + slack, seg.first[-1] - 1))
        d = seg.doc_at(np.clip(align - slack, 0, seg.first[-1] - 1))
        here = np.arange(len(align))
        while len(here):
            of.append(here)
            doc.append(d)
            go = d < last[here]
            here, d = here[go], seg.doc_at(seg.first[d[go] + 1])
        of_, doc_ = np.concatenate(of), np.concatenate(doc)
        s, low, high = align[of_], seg.first[doc_], seg.first[doc_ + 1] - 1
        found = np.zeros(len(s), np.int64)
        for o, t in enumerate(terms):
            p = seg.postings(t)
            if len(p):
                at = np.searchsorted(p, np.maximum(s + o - slack, low))
                found += (at < len(p)) & (p[np.minimum(at, len(p) - 1)] <= np.minimum(s + o + slack, high))
        for k in np.flatnonzero(found >= least):
            key, value = (item, doc_[k]), (s[k], found[k])
            old = best.get(key)
            if old is None or (-old[1], old[0]) > (-value[1], value[0]):
                best[key] = value
    return best


def _search(batches: Iterator[pa.RecordBatch], items: _Items, slack: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            seg = _Segment(row, items.vocabulary)
            if not len(seg.places):
                continue
            phrases = _phrases(seg, items)
            for kind, found in (("phrase", phrases), ("proximity", _near(seg, items, slack))):
                for (item, x), (start, n) in found.items():
                    if kind == "phrase" or (item, x) not in phrases:
                        out.append((items.items[item][0], int(seg.docs[x]), kind, int(start - seg.first[x]), int(n), len(items.items[item][1])))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in MATCH.split(", ")])


def search(index: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, ratio: float = RATIO, slack: int = SLACK, item_batch_bytes: int = 8 << 20) -> DataFrame:
    """Exact phrase and proximity matches of ``benchmark(item_id, text)`` in an index of ``build_index``.

    One row for each item and document that match: the longest run of tokens for ``phrase``; the best alignment
    for ``proximity``, given only where no phrase is. ``start`` is a token's place in the document (a proximity
    alignment may begin up to ``slack`` before it). Items with a null id, a null text or no word match nothing; an
    item of fewer than ``phrase`` tokens must be there whole. Repeated items or documents give one row each time
    they differ in id, and one row if not: that of the phrase, then of most tokens, then of the first place. Texts of any length
    are indexed and searched whole; an empty index or no items give an empty result; other columns are ignored.
    """
    spark = prepare(index.sparkSession)
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    out, batch, held = None, [], 0

    def flush() -> None:
        nonlocal out, batch, held
        prepared = _Items([r["item_id"] for r in batch], [r["text"] for r in batch])
        batch, held = [], 0
        if not prepared.items:
            return
        frequency = np.zeros(len(prepared.vocabulary), np.int64)
        sums = index.select("terms", "counts").mapInArrow(partial(_sums, vocabulary=prepared.vocabulary), "term bigint, n bigint")
        for r in sums.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # at most as many rows as test terms in the batch
            frequency[r["term"]] = r["n"]
        prepared.plan(frequency, phrase, ratio)
        found = index.mapInArrow(partial(_search, items=prepared, slack=slack), MATCH)
        out = found if out is None else out.unionByName(found)

    for r in items.orderBy("item_id", "text").toLocalIterator():
        batch.append(r)
        held += len(r["text"])
        if held >= item_batch_bytes:
            flush()
    if batch:
        flush()
    if out is None:
        return spark.createDataFrame([], MATCH)
    # repeated rows of a document lie in several segments: the best of each pair stays
    best = F.row_number().over(_pairs())
    return out.select("*", best.alias("_rank")).where("_rank = 1").drop("_rank")


def _pairs():
    from pyspark.sql import Window

    return Window.partitionBy("item_id", "doc_id").orderBy("kind", F.desc("matched"), "start", "item_tokens")


def find_leaks(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """Index ``docs`` in the shared folder and search it for ``benchmark``; see ``search`` for the result. The index is deleted afterwards."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = scratch.keep(search(scratch.keep(build_index(docs), "index"), benchmark, **how), "found")
    scratch.drop("index")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """``docs`` without those that match any item, by phrase or proximity; all columns stay, whatever their names.

    Rows with a null doc_id or text stay, and all rows where there are no items; all rows of a doc_id go if one of them matches, so repeated
    rows share a fate; what decides ties in ``search`` doesn't matter here. Texts of any length are searched whole; an empty table stays empty.
    """
    found = find_leaks(docs, benchmark, **how).select("doc_id").distinct()
    return without_ids(docs, found, found.count())
