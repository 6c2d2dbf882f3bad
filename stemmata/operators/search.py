"""The inverted index and the search for source passages.

An index is rows (doc_id, atom_num, hash_value). A search is one equi-join on the hash and one aggregate:
no passage is looked up by itself. Hash 0 (empty grams) finds nothing but counts in the sizes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.functions import fingerprint as fp
from stemmata.functions import tokenize as tk
from stemmata.functions.fingerprint import WIDE
from stemmata.operators.atoms import atoms, documents, side_by_side
from stemmata.operators.fingerprints import fingerprints
from stemmata.session import BROADCAST_BYTES, Scratch, small

S, R = ["doc_id", "atom_num"], ["source_id", "source_atom"]
SIMILARITIES = ["jaccard", "containment", "jaccard-alt1", "containment-alt1"]


BUCKETS = 64
INDEX_ROW = 24  # bytes of a hash in the arrays of an index
CHUNK = 1 << 18  # characters that are searched together


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_index(hashes: DataFrame, path: str, method: str, is_source: bool) -> None:
    """Append passages that the index doesn't have yet for this method; stored by method, side and hash, so searches and lookups prune."""
    spark = hashes.sparkSession
    new = hashes.select(*S, "hash_value", F.lit(method).alias("method"), F.lit(is_source).alias("is_source"), F.pmod("hash_value", F.lit(BUCKETS)).cast("int").alias("bucket"))
    if _there(spark, path):
        new = new.join(read_index(spark, path, method, is_source).select(*S).distinct(), S, "left_anti").select(*new.columns)
    new.repartition("bucket").write.mode("append").partitionBy("method", "is_source", "bucket").parquet(path)


def read_index(spark: SparkSession, path: str, method: str, is_source: bool, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, atom_num, hash_value, bucket) of a method and a side, of ``docs(doc_id)`` only if given."""
    rows = spark.read.parquet(path).where((F.col("method") == method) & (F.col("is_source") == F.lit(is_source))).drop("method", "is_source")
    return rows if docs is None else rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(*rows.columns)


def populated(hashes: DataFrame) -> DataFrame:
    """(documents, passages, hashes): what an index holds."""
    return hashes.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("doc_id", "atom_num").alias("passages"), F.count("*").alias("hashes"))


def require_populated(suspects: DataFrame, sources: DataFrame) -> None:
    """An error where either side is empty."""
    for name, side in (("suspect", suspects), ("source", sources)):
        if side.isEmpty():
            raise ValueError(f"the index has no {name} passages")


def lookup(hashes: DataFrame, values: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(hash_value, doc_id, atom_num) of the index rows with one of ``values(hash_value)``, of ``docs(doc_id)`` only if given."""
    # of a stored index only the buckets that the values lie in are read
    key = ["hash_value", *(["bucket"] if "bucket" in hashes.columns else [])]
    asked = values.select("hash_value").distinct().withColumn("bucket", F.pmod("hash_value", F.lit(BUCKETS)).cast("int")).select(*key)
    found = hashes.join(asked, key, "left_semi")
    if docs is not None:
        found = found.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.select("hash_value", *S)


def with_fingerprints(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, atom_num, fingerprint) of each passage that ``found`` names."""
    return hashes.join(found.select(*S).distinct(), S, "left_semi").groupBy(*S).agg(F.array_sort(F.collect_set("hash_value")).alias("fingerprint"))


def similarity(name: str, shared: Column, a: Column, b: Column) -> Column:
    """Of two sets with ``shared`` common members; ``-alt1`` asks for two at least."""
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}; one of {', '.join(SIMILARITIES)}")
    value = shared / F.nullif(a, F.lit(0)) if name.startswith("containment") else shared / F.nullif(a + b - shared, F.lit(0))
    value = F.coalesce(value, F.lit(0.0))
    return F.when(shared < 2, 0.0).otherwise(value) if name.endswith("-alt1") else value


def candidates(suspects: DataFrame, sources: DataFrame, measure: str = "containment", other_document: bool = False, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, atom_num, source_id, source_atom, shared, confidence): all pairs that share a hash.

    ``other_document`` leaves out pairs within one document, for a corpus that is searched in itself. ``within(source_id)``, with doc_id or
    doc_id and atom_num beside it, names the sources that each suspect is compared with; they are chosen before the hashes are joined.
    """
    a = suspects.select(*S, "hash_value").distinct()
    b = sources.select(F.col("doc_id").alias("source_id"), F.col("atom_num").alias("source_atom"), "hash_value").distinct()
    left, right = a.where("hash_value <> 0"), b.where("hash_value <> 0")
    if within is None:
        pairs = left.join(right, "hash_value")
    else:
        key = [c for c in within.columns if c != "source_id"]
        right = right.join(within.select("source_id").distinct(), "source_id", "left_semi")
        pairs = left.join(within.distinct(), key).join(right, ["source_id", "hash_value"])
    if other_document:
        pairs = pairs.where("doc_id <> source_id")
    shared = pairs.groupBy(*S, *R).agg(F.count("*").alias("_nonzero"))
    # hash 0 is in the fingerprints that are compared
    size_a = a.groupBy(*S).agg(F.count("*").alias("_a"), F.max((F.col("hash_value") == 0).cast("int")).alias("_za"))
    size_b = b.groupBy(*R).agg(F.count("*").alias("_b"), F.max((F.col("hash_value") == 0).cast("int")).alias("_zb"))
    j = shared.join(size_a, S).join(size_b, R)
    n = F.col("_nonzero") + F.col("_za") * F.col("_zb")
    return j.select(*S, *R, n.alias("shared"), similarity(measure, n, F.col("_a"), F.col("_b")).alias("confidence"))


def best(found: DataFrame, passages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` candidates of each of ``passages(doc_id, atom_num)``: by confidence, then smaller source and atom.

    A passage without candidates has one row with no source and confidence 0.
    """
    rank = F.row_number().over(Window.partitionBy(*S).orderBy(F.desc("confidence"), "source_id", "source_atom"))
    chosen = found.withColumn("rank", rank).where(F.col("rank") <= top)
    out = passages.select(*S).distinct().join(chosen, S, "left")
    return out.select(*S, F.coalesce("rank", F.lit(1)).alias("rank"), *R, F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def search(suspects: DataFrame, sources: DataFrame, measure: str = "containment", passages: DataFrame | None = None, other_document: bool = False, short: DataFrame | None = None) -> DataFrame:
    """The likeliest source of each passage. Those in ``short(doc_id, atom_num)`` are too short to judge and get 0."""
    found = candidates(suspects, sources, measure, other_document)
    if short is not None:
        found = found.join(short.select(*S), S, "left_anti")
    return best(found, suspects if passages is None else passages)


def two_level(full_suspects: DataFrame, full_sources: DataFrame, suspects: DataFrame, sources: DataFrame, measure: str = "containment", search_n: int = 5, passages_first: bool = False, other_document: bool = False) -> DataFrame:
    """Documents first, then passages inside the ``search_n`` best of them.

    Whole suspects are compared with whole sources by containment or, with ``passages_first``, each passage is. A
    passage whose document (or which itself) meets no source has no candidate.
    """
    key = S if passages_first else ["doc_id"]
    level1 = candidates(suspects if passages_first else full_suspects, full_sources, "containment", other_document)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence"), "source_id"))
    chosen = level1.withColumn("_r", rank).where(f"_r <= {search_n} AND confidence > 0").select(*key, "source_id").distinct()
    return best(candidates(suspects, sources, measure, other_document, chosen), suspects)


class Method(NamedTuple):
    """How texts are cut and fingerprinted: the arguments of ``fingerprints``."""

    method: str
    n: int
    k: int = 0
    atom: str = "full"
    size: int = 5000
    span: int = fp.SPAN

    def prints(self, docs: DataFrame) -> DataFrame:
        return fingerprints(docs, *self)


class _Index(NamedTuple):
    """Fingerprints of one side as arrays: who holds each hash, and of each passage its id, number, size and whether it has hash 0."""

    keys: np.ndarray
    starts: np.ndarray
    holders: np.ndarray
    ids: np.ndarray
    nums: np.ndarray
    sizes: np.ndarray
    zeros: np.ndarray

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages that hold any of some different hashes above 0, in order of (id, number), and how many."""
        if not len(self.keys):
            return self.holders, self.holders
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == hashes]
        return np.unique(self.holders[self.places(at)[1]], return_counts=True)  # type: ignore[return-value]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``at``, place among ``holders``) of everyone that holds the keys ``at``."""
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        return np.repeat(np.arange(len(at)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())

    def sieve(self) -> np.ndarray:
        """Whether any key has these low bits: most hashes that no passage holds are told by it."""
        bits = np.zeros(1 << max(10, (16 * len(self.keys)).bit_length()), bool)
        bits[self.keys & (len(bits) - 1)] = True
        return bits

    def hits(self, sieve: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, key): the different keys among each owner's hashes, in order of owner."""
        some = np.flatnonzero(sieve[hashes & (len(sieve) - 1)])
        owner, hashes = owner[some], hashes[some]
        if not len(some):
            return owner, owner
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        real = self.keys[at] == hashes
        both = np.unique(owner[real] * len(self.keys) + at[real])
        return both // len(self.keys), both % len(self.keys)

    def pairs(self, owner: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, holder, common keys above 0) of all that meet in ``hits``, in order; blocks of whole owners, ``PAIRS`` meetings at a time."""
        count = np.append(0, np.cumsum(self.starts[at + 1] - self.starts[at]))
        begin = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        k = 0
        while k < len(begin) - 1:
            end = max(k + 1, int(np.searchsorted(count[begin], count[begin[k]] + PAIRS, "right")) - 1)
            lo, hi = begin[k], begin[end]
            k, both, n = end, None, None
            while lo < hi:  # an owner with more meetings than that is counted bit by bit
                to = min(hi, max(lo + 1, int(np.searchsorted(count, count[lo] + PAIRS, "right")) - 1))
                which, place = self.places(at[lo:to])
                new, m = np.unique(owner[lo:to][which] * len(self.ids) + self.holders[place], return_counts=True)
                if both is not None:
                    new, back = np.unique(np.concatenate([both, new]), return_inverse=True)
                    m = np.bincount(back, np.concatenate([n, m])).astype(np.int64)
                both, n, lo = new, m, to
            yield both // len(self.ids), both % len(self.ids), n


PAIRS = 1 << 20


def _index(hashes: DataFrame, alike: int | None = None, by_id: bool = False) -> tuple[DataFrame, Broadcast | None]:
    """The different rows of an index, written, and its arrays for every worker where they are small.

    Of passages with the same hashes only the first ``alike`` in order of (id, number) are in the arrays, if given: what
    is likeliest among equals by that order needs no more. ``by_id``: ids are chosen first, so where one has several passages none is left out.
    """
    rows = Scratch(hashes.sparkSession, "side").keep(hashes.select(*S, "hash_value").distinct(), "table")
    if rows.count() * INDEX_ROW > BROADCAST_BYTES:
        return rows, None
    t = rows.orderBy(*S, "hash_value").toPandas()
    ids, nums, h = t["doc_id"].to_numpy(np.int64), t["atom_num"].to_numpy(np.int32), t["hash_value"].to_numpy(np.int64)
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(nums) != 0))[: len(h)]
    begin = np.flatnonzero(new)
    if alike is not None and not (by_id and len(np.unique(ids[begin])) < len(begin)):
        seen: Counter[bytes] = Counter()
        fresh = np.zeros(len(begin), bool)
        for k, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(h)])):
            own = hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
            fresh[k] = seen[own] < alike
            seen[own] += 1
        some = fresh[np.cumsum(new) - 1]
        ids, nums, h, new = ids[some], nums[some], h[some], new[some]
    who = np.cumsum(new) - 1
    count = int(new.sum())
    order = np.argsort(h[h != 0], kind="stable")
    keys, starts = np.unique(h[h != 0][order], return_index=True)
    zeros = np.zeros(count, np.int64)
    zeros[who[h == 0]] = 1
    own = _Index(keys, np.append(starts, len(order)), who[h != 0][order], ids[new], nums[new], np.bincount(who, minlength=count), zeros)
    return rows, hashes.sparkSession.sparkContext.broadcast(own)


def _alike(name: str, shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """``similarity`` of arrays."""
    size = np.broadcast_to(np.asarray(a if name.startswith("containment") else a + b - shared, np.float64), shared.shape)
    value = np.divide(shared, size, out=np.zeros(len(shared)), where=size != 0)
    return np.where(shared < 2, 0.0, value) if name.endswith("-alt1") else value


FOUND = "doc_id bigint, atom_num int, source_id bigint, source_atom int, shared bigint, confidence double"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64())


def _found(cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], ["doc_id", "atom_num", *R, "shared", "confidence"])


def _hashes(text: str, m: Method) -> np.ndarray:
    return np.array(fp.fingerprint(text, m.method, m.n, m.k, m.span), np.int64)


def _prints(texts: list[str], cuts: list[list[tk.Span]], m: Method) -> tuple[np.ndarray, np.ndarray]:
    """(piece, hash) of all pieces of some texts, in order of piece; a hash may stand twice."""
    if m.method == "winnow-k":
        return fp.winnowed(texts, cuts, m.n, m.k, m.span)
    own = [_hashes(t[a:b], m) for t, c in zip(texts, cuts) for a, b in c]
    return np.repeat(np.arange(len(own)), [len(h) for h in own]), np.concatenate([np.zeros(0, np.int64), *own])


def _sizes(owner: np.ndarray, hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many different hashes each owner that ``asked`` marks has; 0 for others."""
    some = asked[owner]
    owner, hashes = owner[some], hashes[some]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(hashes) != 0))[: len(owner)]
    return np.bincount(owner[new], minlength=len(asked))


def _ranks(owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner, falling score and id, and the place from 0 of each of its members within its owner."""
    order = np.lexsort((ids, -score, owner))
    first = np.flatnonzero(np.diff(owner[order], prepend=-1))
    return order, np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))


def _suspects(batches: Iterator[pa.RecordBatch], m: Method, index: Broadcast, measure: str, least: int, all_passages: bool, first: str, search_n: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to the best source of each passage, or a row without one.

    Passages below ``least`` characters are not judged; with ``all_passages`` those without a hash give a row too. ``first`` is ``""``,
    ``document`` or ``passage``: what chooses ``search_n`` sources by containment before.
    """
    index = index.value
    sieve = index.sieve()
    # sources by number, so that a suspect and a source make one key
    number = np.cumsum(np.append(0, np.diff(index.ids) != 0)) if len(index.ids) else index.ids
    ids, texts, size = [], [], 0
    for doc, own in _by_id(batches):
        ids += [doc] * len(own)
        texts += own
        size += sum(map(len, own))
        if size > CHUNK:
            yield _best_sources(ids, texts, m, index, sieve, number, measure, least, all_passages, first, search_n)
            ids, texts, size = [], [], 0
    if ids:
        yield _best_sources(ids, texts, m, index, sieve, number, measure, least, all_passages, first, search_n)


def _by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """Each id of rows (doc_id, text) with its texts; rows of an id follow each other."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for doc, own in groupby(rows, itemgetter(0)):
        yield doc, [text for _, text in own]


def _best_sources(ids: list[int], texts: list[str], m: Method, index: _Index, sieve: np.ndarray, number: np.ndarray, measure: str, least: int, all_passages: bool, first: str, search_n: int) -> pa.RecordBatch:
    """``_suspects`` of some texts: all of their passages are counted together; those of one id and number are one passage."""
    cuts = [tk.tokenize(t, m.atom, m.size) for t in texts]
    per = np.array([len(c) for c in cuts], np.int64)
    names, place = np.unique(np.array(ids, np.int64), return_inverse=True)
    num = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    piece = np.repeat(place, per) * (per.max() + 1) + num
    _, at, passage = np.unique(piece, return_index=True, return_inverse=True)
    total, doc, num = len(at), np.repeat(place, per)[at], num[at]
    owner, hashes = _prints(texts, cuts, m)
    owner = passage[owner]
    out = [np.zeros(total, np.int64) for _ in range(4)]
    found, value = np.zeros(total, bool), np.zeros(total)
    own, at = index.hits(sieve, owner, hashes)
    if least:
        long = np.ones(total, bool)
        long[passage[np.array([b - a < least for c in cuts for a, b in c], bool)]] = False
        own, at = own[long[own]], at[long[own]]
    held = np.zeros(total, bool)
    held[own] = True
    sizes, zero = _sizes(owner, hashes, held), np.zeros(total, np.int64)
    zero[owner[hashes == 0]] = 1
    chosen = _chosen(texts, place, m, index, sieve, number, search_n) if first == "document" else None
    for who, holder, n in index.pairs(own, at):
        n = n + zero[who] * index.zeros[holder]
        if chosen is not None:
            some = np.isin(doc[who] * len(number) + number[holder], chosen)
            who, holder, n = who[some], holder[some], n[some]
        elif first == "passage":
            order, rank = _ranks(who, _alike("containment", n, sizes[who], 0), index.ids[holder])
            top = order[rank < search_n]
            some = np.isin(who * len(number) + number[holder], who[top] * len(number) + number[holder[top]])
            who, holder, n = who[some], holder[some], n[some]
        c = _alike(measure, n, sizes[who], index.sizes[holder])
        start = np.flatnonzero(np.diff(who, prepend=-1))
        # of equals the first, in order of source and its atom
        best = np.flatnonzero(c == np.repeat(np.maximum.reduceat(c, start), np.diff(np.append(start, len(who))))) if len(who) else start
        best = best[np.unique(who[best], return_index=True)[1]]
        w = who[best]
        found[w], value[w] = True, c[best]
        for col, v in zip(out, (index.ids[holder[best]], index.nums[holder[best]], n[best])):
            col[w] = v
    shown = np.flatnonzero(np.ones(total, bool) if all_passages else np.bincount(owner, minlength=total) > 0)
    none = ~found[shown]
    cols = [names[doc[shown]], num[shown], *(pa.array(c[shown], t, mask=none) for c, t in zip(out, (pa.int64(), pa.int32()))), out[2][shown], value[shown]]
    return _found(cols)


def _chosen(texts: list[str], place: np.ndarray, m: Method, index: _Index, sieve: np.ndarray, number: np.ndarray, search_n: int) -> np.ndarray:
    """The sources of the ``search_n`` passages that hold most of the texts of each ``place``: it times all sources, plus the source's number."""
    owner, hashes = _prints(texts, [[(0, len(t))] for t in texts], m)
    owner = place[owner]
    zero = np.zeros(len(texts), np.int64)
    zero[owner[hashes == 0]] = 1
    out = [np.zeros(0, np.int64)]
    for who, holder, n in index.pairs(*index.hits(sieve, owner, hashes)):
        # all are divided by the size of the same texts
        order, rank = _ranks(who, n + zero[who] * index.zeros[holder], index.ids[holder])
        top = order[rank < search_n]
        out.append(np.unique(who[top] * len(number) + number[holder[top]]))
    return np.concatenate(out)


def _sources(batches: Iterator[pa.RecordBatch], m: Method, index: Broadcast, measure: str) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of sources to the best of them for each passage of the index."""
    index = index.value
    c0 = np.full(len(index.ids), -1.0)
    n0, s0, a0 = (np.zeros(len(index.ids), np.int64) for _ in range(3))
    for doc, texts in _by_id(batches):
        cuts = [tk.tokenize(t, m.atom, m.size) for t in texts]
        for num in range(max(map(len, cuts))):
            own = [_hashes(t[c[num][0] : c[num][1]], m) for t, c in zip(texts, cuts) if num < len(c)]
            h = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
            who, n = index.shared(h[h != 0])
            n = n + index.zeros[who] * int((h == 0).any())
            c = _alike(measure, n, index.sizes[who], len(h))
            better = (c > c0[who]) | ((c == c0[who]) & ((doc < s0[who]) | ((doc == s0[who]) & (num < a0[who]))))
            w = who[better]
            c0[w], n0[w], s0[w], a0[w] = c[better], n[better], doc, num
    w = np.flatnonzero(c0 >= 0)
    yield _found([index.ids[w], index.nums[w], s0[w], a0[w], n0[w], c0[w]])


def search_texts(docs: DataFrame, method: Method, sources: DataFrame, measure: str = "containment", least: int = 0) -> DataFrame:
    """As ``search`` of all passages of ``docs(doc_id, text)``; those under ``least`` characters are not judged.

    Where the sources are small, each passage meets them in the task that reads it, and nothing is shuffled.
    """
    similarity(measure, F.lit(1), F.lit(1), F.lit(1))
    rows, index = _index(sources, 1)
    alone, together, apart = side_by_side(docs) if index is not None else (None, None, docs)
    met = partial(_suspects, m=method, index=index, measure=measure, least=least, all_passages=True, first="", search_n=0)
    out = [x.mapInArrow(met, FOUND).select(*S, F.lit(1).alias("rank"), *R, "shared", "confidence") for x in (alone, together) if x is not None]
    if apart is not None:
        pieces = atoms(apart, method.atom, method.size).select(*S, "start", "end")
        out.append(search(method.prints(apart), rows, measure, pieces, short=pieces.where(F.col("end") - F.col("start") < least) if least else None))
    return reduce(DataFrame.unionByName, out)


def search_among_texts(suspects: DataFrame, docs: DataFrame, method: Method, measure: str = "containment") -> DataFrame:
    """As ``search`` of ``suspects`` among the passages of ``docs(doc_id, text)``.

    Where the suspects are small, each task keeps the best of its documents for each of them.
    """
    similarity(measure, F.lit(1), F.lit(1), F.lit(1))
    rows, index = _index(suspects)
    if index is None:
        return search(rows, method.prints(docs), measure)
    alone, together, apart = side_by_side(docs)
    found = [x.mapInArrow(partial(_sources, m=method, index=index, measure=measure), FOUND) for x in (alone, together) if x is not None]
    if apart is not None:
        found.append(candidates(rows, method.prints(apart), measure))
    return best(reduce(DataFrame.unionByName, found), rows)


def two_level_texts(docs: DataFrame, method: Method, sources: DataFrame, measure: str = "containment", search_n: int = 5, passages_first: bool = False) -> DataFrame:
    """As ``two_level`` of the passages of ``docs(doc_id, text)``, whole sources and their passages being the same."""
    similarity(measure, F.lit(1), F.lit(1), F.lit(1))
    rows, index = _index(sources, search_n, by_id=True)
    alone, together, apart = side_by_side(docs) if index is not None else (None, None, docs)
    met = partial(_suspects, m=method, index=index, measure=measure, least=0, all_passages=False, first="passage" if passages_first else "document", search_n=search_n)
    out = [x.mapInArrow(met, FOUND).select(*S, F.lit(1).alias("rank"), *R, "shared", "confidence") for x in (alone, together) if x is not None]
    if apart is not None:
        prints = method.prints(apart)
        out.append(two_level(prints if passages_first else method._replace(atom="full").prints(apart), rows, prints, rows, measure, search_n, passages_first))
    return reduce(DataFrame.unionByName, out)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source_id, text, passage) to (doc_id, source_id, start, end) of every place of the passage."""
    for batch in batches:
        rows, starts, ends = [], [], []
        for k, (text, passage) in enumerate(zip(batch.column(2), batch.column(3))):
            text, passage = text.as_py(), passage.as_py()
            at = text.find(passage)
            while at >= 0:
                rows.append(k)
                starts.append(at)
                ends.append(at + len(passage))
                at = text.find(passage, at + 1)
        ids = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "source_id", "start", "end"])


def _short(batches: Iterator[pa.RecordBatch], passages: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to every place of each passage, by one automaton of all of them."""
    ids: dict[str, list[int]] = {}
    for i, text in passages:
        ids.setdefault(text, []).append(i)
    automaton = ahocorasick.Automaton()
    for text, own in ids.items():
        automaton.add_word(text, (len(text), own))
    automaton.make_automaton()
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out += [(doc, i, last + 1 - n, last + 1) for last, (n, own) in automaton.iter(text) for i in own]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "source_id", "start", "end"])


PLACE = "doc_id bigint, source_id bigint, start int, end int"


def occurrences(docs: DataFrame, passages: DataFrame, k: int = 8, t: int = 24, block_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, source_id, start, end): every place where a document holds a passage word for word, overlapping ones too.

    Passages of ``block_chars`` in all are looked for by one automaton, in the task that reads the texts. For more of them
    winnowed fingerprints give the candidates, which the texts confirm. A passage of ``t`` characters or more
    (punctuation and blanks aside) shares a fingerprint wherever it stands; shorter ones, which may have none, are looked for in every document
    by one automaton for each ``block_chars`` of them. Nulls and empty passages are found nowhere; of rows that repeat an id each is searched.
    """
    p = passages.select(F.col("item_id").alias("doc_id"), "text")
    a, b = documents(docs), documents(p).select(F.col("doc_id").alias("source_id"), F.col("text").alias("_p")).where("_p <> ''")
    if (b.agg(F.sum(F.length("_p"))).first()[0] or 0) <= block_chars:
        few = [(r["source_id"], r["_p"]) for r in b.collect()]
        return a.mapInArrow(partial(_short, passages=few), PLACE)
    own = fingerprints(p, "winnow-k", k, t, span=WIDE).select(F.col("doc_id").alias("source_id"), "hash_value")
    own = Scratch(docs.sparkSession, "occurrences").keep(own, "own")
    # two hashes at least make sure that one isn't the first of the passage alone
    enough = own.groupBy("source_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("source_id")
    asked = small(own.join(enough, "source_id", "left_semi"), own.count(), 32)
    pairs = fingerprints(docs, "winnow-k", k, t, span=WIDE).select("doc_id", "hash_value").join(asked, "hash_value").select("doc_id", "source_id").distinct()
    j = pairs.join(a, "doc_id").join(b, "source_id").where("instr(text, _p) > 0")
    found = j.select("doc_id", "source_id", "text", "_p").mapInArrow(_places, PLACE)
    block, held = [], 0
    for r in b.join(enough, "source_id", "left_anti").toLocalIterator():
        block.append((r["source_id"], r["_p"]))
        held += len(r["_p"])
        if held >= block_chars:
            found = found.unionByName(a.mapInArrow(partial(_short, passages=block), PLACE))
            block, held = [], 0
    if block:
        found = found.unionByName(a.mapInArrow(partial(_short, passages=block), PLACE))
    return found
