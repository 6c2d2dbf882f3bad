"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Documents are sets of word 3-gram hashes. Coordinate k of a signature is min over the set of
pi((sigma(x) - k) mod 2^32): one permutation sigma spreads the values, one permutation pi, shifted by k, serves
all ``K`` coordinates. ``BANDS`` bands of ``ROWS`` coordinates give buckets; documents that share one are compared
exactly. With 32 bands of 4, a pair of similarity 0.6 shares a bucket with probability 0.99, of 0.55 with 0.95.

Equal sets are one class first, so thousands of copies cost one signature each and no pair. All different sets of a bucket are
compared, by products of incidence matrices; a pair that shares several buckets is counted in the earliest. A bucket
of more than ``PART`` sets is a grid of blocks, each a group of its own in the shuffle, so no task holds more than two parts.
No pair leaves a block: it gives each of its members' links, the highest similarity, and one member that they lead to;
classes grow over blocks by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.llm import _text
from stemmata.session import Scratch, prepare, small, without_ids

SHINGLE, BANDS, ROWS, THRESHOLD, PART = 3, 32, 4, 0.5, 1024
_U32, _U64 = np.uint32, np.uint64
_TINY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
SIGNATURE = "doc_id bigint, t bigint, set_hash binary, bands array<bigint>"


def _permute(x: np.ndarray, seed: int, spare: np.ndarray | None = None) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, 0x7FEB352D ^ (seed << 1)), (15, 0x846CA68B ^ (seed << 2)), (16, None)):
        np.right_shift(x, _U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, _U32(factor | 1), out=x)
    return x


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word 3-grams; of all its words if it has fewer.

    A text without words that isn't blank has one hash, of its characters; a blank one has none.
    """
    w = _text.words(col)
    h, first = w.hashes, w.first
    grams = h.copy()
    if len(h) >= SHINGLE:
        grams = h[: -SHINGLE + 1] * _U64(0x9E3779B97F4A7C15)
        for k in range(1, SHINGLE):
            grams = (grams ^ (grams >> _U64(29))) * _U64(0xBF58476D1CE4E5B9) + h[k : len(h) - SHINGLE + 1 + k]
        grams = _text.mix(grams)
    out = []
    for k in range(len(first) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            few = np.zeros(1, np.uint64)
            for x in h[a:b]:
                few = (few ^ (few >> _U64(29))) * _U64(0xBF58476D1CE4E5B9) + x
            out.append(_text.mix(few + _U64(b - a)))
        else:
            raw = (col[k].as_py() or "").strip()
            if raw:
                c, q = _text.prefix(np.frombuffer(raw.encode(), np.uint8))
                out.append(_text.mix(c[-1:] * q[:1] + _U64(11)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One row of ``bands * rows`` coordinates for each set, none of which may be empty."""
    k = bands * rows
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    shifts = np.arange(k, dtype=np.uint32)
    block = 256
    grid, spare = np.empty((block, k), np.uint32), np.empty((block, k), np.uint32)
    values = _permute((np.concatenate(sets) >> _U64(32)).astype(np.uint32), 1) if sets else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    doc = 0
    for at in range(0, len(values), block):
        n = min(block, len(values) - at)
        g = grid[:n]
        np.subtract(values[at : at + n, None], shifts, out=g)
        _permute(g, 2, spare[:n])
        while starts[doc + 1] <= at:
            doc += 1
        d = doc
        while d < len(sets) and starts[d] < at + n:
            a, b = max(starts[d], at) - at, min(starts[d + 1], at + n) - at
            np.minimum(out[d], g[a:b].min(axis=0), out=out[d])
            d += 1
    return out


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, t, text) to their sets' fingerprints and buckets; both are null for a text without a set."""
    salt = _text.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        for at, col in _text.chunks(batch.column(2)):
            sets = shingle_sets(col)
            keep = [k for k, s in enumerate(sets) if len(s)]
            marks: list[bytes | None] = [None] * len(sets)
            buckets: list[bytes | None] = [None] * len(sets)
            if keep:
                sig = signatures([sets[k] for k in keep], bands, rows).reshape(len(keep), bands, rows).astype(np.uint64)
                h = np.broadcast_to(salt, (len(keep), bands)).copy()
                for r in range(rows):
                    h = (h ^ (h >> _U64(31))) * _U64(0xBF58476D1CE4E5B9) + sig[:, :, r]
                h = _text.mix(h)
                for n, k in enumerate(keep):
                    # the set's 128-bit fingerprint: two sums of remixed members, and their number
                    s = sets[k]
                    marks[k] = np.array([s.sum(dtype=np.uint64), _text.mix(s ^ _U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes()
                    buckets[k] = h[n].tobytes()
            n = len(col)
            own = np.cumsum([0, *(0 if x is None else bands for x in buckets)]).astype(np.int32)
            flat = np.frombuffer(b"".join(x for x in buckets if x is not None), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(own), pa.array(flat))], ["doc_id", "t", "set_hash", "bands"]
            )


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(set, token) of every member that two sets hold at least, tokens numbered from 0, and their number."""
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    kept, number = np.unique(number[shared], return_inverse=True)
    return owner[shared], number, len(kept)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``left`` shares with each of ``right``: products of incidence matrices, some tokens at a time."""
    if len(left) * len(right) <= 4:
        return np.array([[np.intersect1d(a, b, assume_unique=True).size for b in right] for a in left], np.float64).reshape(len(left), len(right))
    owner, number, n = _incidence(left + right)
    out, step = np.zeros((len(left), len(right))), max(64, (8 << 20) // (len(left) + len(right)))
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for at in range(0, n, step):
        i, j = np.searchsorted(number, [at, at + step])
        x = np.zeros((len(left) + len(right), min(step, n - at)), np.float32)
        x[owner[i:j], number[i:j] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def link(left: list[np.ndarray], left_bands: np.ndarray, right: list[np.ndarray], right_bands: np.ndarray, band: int, threshold: float, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, highest similarity, smallest index linked to it over any path) of each set of ``left + right``.

    Counted are pairs that reach ``threshold`` and share no bucket of an earlier band: each pair of the corpus once. ``within`` says
    that both sides are the same, whose pairs are taken in one order.
    """
    a, b = (np.array([len(s) for s in x], np.float64) for x in (left, right))
    new = np.ones((len(left), len(right)), bool)
    for k in range(band):
        new &= left_bands[:, k][:, None] != right_bands[:, k][None]
    new &= np.minimum(a[:, None], b[None]) >= threshold * np.maximum(a[:, None], b[None])
    if within:
        new = np.triu(new, 1)
    n = len(left) + (0 if within else len(right))
    links, top, root = np.zeros(n, np.int64), np.zeros(n), np.arange(n)
    if not new.any():
        return links, top, root
    # only the rows and columns that have a pair to be compared
    r, c = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
    both = overlaps([left[k] for k in r], [right[k] for k in c])
    j = np.zeros(new.shape)
    j[np.ix_(r, c)] = both / (a[r][:, None] + b[c][None] - both)
    near = new & (j >= threshold)
    j[~near] = 0
    at = slice(0, n) if within else slice(len(left), n)
    links[: len(left)] += near.sum(axis=1)
    links[at] += near.sum(axis=0)
    top[: len(left)] = np.maximum(top[: len(left)], j.max(axis=1))
    top[at] = np.maximum(top[at], j.max(axis=0))
    while True:
        low = root.copy()
        rows, cols = root[: len(left)], root[at]
        low[: len(left)] = np.minimum(low[: len(left)], np.where(near, cols[None], n).min(axis=1))
        low[at] = np.minimum(low[at], np.where(near, rows[:, None], n).min(axis=0))
        low = low[low]
        if (low == root).all():
            return links, top, root
        root = low


LINKED = "d bigint, m bigint, links bigint, jaccard double, rd bigint, rm bigint"


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (band, k, bi, bj, part, d, m, bands, text) in order of block and id, to the links of each block's members; a block may span batches."""
    names = [x.split()[0] for x in LINKED.split(", ")]
    now: tuple[int, ...] | None = None
    parts: tuple[list, list] = ([], [])

    def done() -> pa.RecordBatch | None:
        if now is None:
            return None
        _, band, bi, bj = now
        left = parts[0]
        right = left if bi == bj else parts[1]
        if not left or not right or (bi == bj and len(left) < 2):
            return None
        marks = [np.array([x[1] for x in side]) for side in (left, right)]
        links, top, root = link([x[2] for x in left], marks[0], [x[2] for x in right], marks[1], band, threshold, bi == bj)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        ids = [x[0] for x in (left if bi == bj else left + right)]
        cols = [[ids[k][0] for k in some], [ids[k][1] for k in some], links[some], top[some], [ids[root[k]][0] for k in some], [ids[root[k]][1] for k in some]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names)

    for batch in batches:
        key = np.stack([np.asarray(batch.column(c), np.int64) for c in range(4)], 1)
        part, d, m = (np.asarray(batch.column(c), np.int64) for c in (4, 5, 6))
        bands = batch.column(7)
        for at, col in _text.chunks(batch.column(8)):
            for k, s in enumerate(shingle_sets(col), at):
                if tuple(key[k]) != now:
                    if (out := done()) is not None:
                        yield out
                    now, parts = tuple(key[k].tolist()), ([], [])
                side, node = parts[0 if part[k] == now[2] else 1], (int(d[k]), int(m[k]))
                side.append((node, np.asarray(bands[k].values, np.int64), s))
    if (out := done()) is not None:
        yield out


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components by large-star and small-star steps: ``edges(u, v)`` to ``(node, root)``, root the smallest id.

    A root is not listed as a node. Each round's edges are written as a table; a round at least halves the distance
    to the root in practice, and the loop ends when a round changes nothing.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    before, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        nxt = scratch.keep(nxt, f"{name}{k}")
        mark = nxt.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20,0))"))).first()
        scratch.drop(f"{name}{k - 1}")
        if mark == before or mark[0] == 0:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = mark, nxt


class _Found(NamedTuple):
    """``rows(doc_id, m, root, links, copies, jaccard)`` of every document; ``m`` is 0, or the text's hash where rows repeat a doc_id."""

    rows: DataFrame
    signed: DataFrame
    repeated: DataFrame  # the doc_ids of several rows
    n_repeated: int


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _marked(df: DataFrame, found: _Found | tuple[DataFrame, int]) -> DataFrame:
    """``df(doc_id, t)`` with ``m``."""
    repeated, n = (found.repeated, found.n_repeated) if isinstance(found, _Found) else found
    if not n:
        return df.withColumn("m", F.lit(0).cast("bigint"))
    return df.join(small(repeated.select("doc_id", F.lit(True).alias("_many")), n, 40), "doc_id", "left").withColumn("m", F.when(F.col("_many"), F.col("t")).otherwise(F.lit(0))).drop("_many")


def _groups(docs: DataFrame, scratch: Scratch, threshold: float, bands: int, rows: int) -> _Found:
    prepare(docs.sparkSession)
    texts = _documents(docs)
    signed = scratch.keep(texts.mapInArrow(partial(_sign, bands=bands, rows=rows), SIGNATURE), "signed")
    repeated = scratch.keep(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    n_repeated = repeated.count()
    # a node is a document, or one of the different sets of words that rows with one doc_id have
    nodes = _marked(signed.where("set_hash IS NOT NULL"), (repeated, n_repeated)).select("doc_id", "m", "set_hash", "bands")
    if n_repeated:
        nodes = nodes.groupBy("doc_id", "set_hash").agg(F.min("m").alias("m"), F.min("bands").alias("bands")).select("doc_id", "m", "set_hash", "bands")
    # equal sets are one: an aggregate and a join, not a window, so that the copies of a hot text needn't fit one task
    plain = nodes.select("doc_id", "m", "set_hash")
    first = plain.groupBy("set_hash").agg(F.min(F.struct("doc_id", "m")).alias("rep"), F.count("*").alias("copies"))
    same = scratch.keep(plain.join(first, "set_hash").select("doc_id", "m", "rep", (F.col("copies") - 1).alias("copies")), "same")
    reps = nodes.join(same.where("rep.doc_id <> doc_id OR rep.m <> m").select("doc_id", "m"), ["doc_id", "m"], "left_anti")
    cells = reps.select(F.col("doc_id").alias("d"), "m", F.posexplode("bands").alias("k", "band"))
    full = scratch.keep(cells.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "full")
    n_full = full.count()
    members = scratch.keep(cells.join(small(full, n_full, 24), "band"), "members")
    # buckets with the same members are one, that of the earliest band
    marks = members.groupBy("band", "k", "n").agg(F.bit_xor(F.xxhash64("d", "m")).alias("x"), F.sum(F.pmod(F.xxhash64("m", "d"), F.lit(1 << 40))).alias("y"))
    chosen = marks.groupBy("n", "x", "y").agg(F.min(F.struct("k", "band")).alias("b")).select("b.band", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    # a bucket of more than PART members is cut into parts, and compared part by part: a block is a group of its own
    part, other = F.pmod(F.xxhash64("d", "m"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    blocks = members.join(small(chosen, n_full, 24), "band").select("band", "k", part.alias("part"), "d", "m", F.explode(other).alias("o"))
    blocks = blocks.select("band", "k", F.least("part", "o").alias("bi"), F.greatest("part", "o").alias("bj"), "part", "d", "m")
    wanted = scratch.keep(members.select(F.col("d").alias("doc_id"), "m").distinct(), "wanted")
    n_wanted = wanted.count()
    own = _marked(texts.join(small(wanted.select("doc_id"), n_wanted, 40), "doc_id", "left_semi"), (repeated, n_repeated)).select(F.col("doc_id").alias("d"), "m", "text")
    if n_repeated:  # equal rows are one
        own = own.groupBy("d", "m").agg(F.min("text").alias("text"))
    carried = reps.join(small(wanted, n_wanted, 48), ["doc_id", "m"], "left_semi").select(F.col("doc_id").alias("d"), "m", "bands")
    rows_ = blocks.join(own.join(carried, ["d", "m"]), ["d", "m"]).select("band", "k", "bi", "bj", "part", "d", "m", "bands", "text")
    block = ["band", "k", "bi", "bj"]
    ordered = rows_.repartition(*block).sortWithinPartitions(*block, "d", "m")
    linked = scratch.keep(ordered.mapInArrow(partial(_verify, threshold=threshold), LINKED), "linked")
    node = lambda d, m: F.struct(F.col(d).alias("doc_id"), F.col(m).alias("m"))
    roots = components(linked.select(node("d", "m").alias("u"), node("rd", "rm").alias("v")), scratch)
    links = linked.groupBy(node("d", "m").alias("node")).agg(F.sum("links").alias("links"), F.max("jaccard").alias("jaccard"))
    info = links.join(roots, "node", "left").select(F.col("node").alias("rep"), "links", "jaccard", F.coalesce("root", "node").alias("root"))
    rows_ = same.join(info, "rep", "left").select(
        "doc_id", "m", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies", F.when(F.col("copies") > 0, 1.0).otherwise(F.col("jaccard")).alias("jaccard")
    )
    out = scratch.keep(rows_, "groups")
    for name in ("same", "full", "members", "wanted", "linked"):
        scratch.drop(name)
    return _Found(out, signed, repeated, n_repeated)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, keep_id, links, copies, jaccard): a row for each document of ``docs(doc_id, text)`` that is like another.

    A class is all documents joined by pairs of similarity ``threshold`` or more; ``keep_id``, its smallest doc_id, names it. ``copies``
    counts the other documents with an equal set; ``links`` the different texts (equal sets count once) that share a bucket with the
    document's and reach the threshold, each verified exactly; ``jaccard`` is the highest such similarity, 1.0 where there are copies.
    Case and punctuation are ignored. Null ids, null texts and blank texts are in no class; a text without words equals only
    the same text. Rows that repeat a doc_id are one document if their sets are equal, else one for each different set. Texts of
    any length are taken whole. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    found = _groups(docs, scratch, threshold, bands, rows)
    scratch.drop("signed")
    scratch.drop("repeated")
    return found.rows.where("links > 0 OR copies > 0").select("doc_id", F.col("root.doc_id").alias("keep_id"), "links", "copies", F.round("jaccard", 9).alias("jaccard"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each class, all its columns as they were, whatever their names.

    Rows that repeat a doc_id stay if their texts aren't alike; of equal rows one stays, of rows with one id and an equal set that with
    the smallest hash of its text. Rows with a null doc_id, and null or blank texts, stay. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    found = _groups(docs, scratch, threshold, bands, rows)
    gone = found.rows.where("root.doc_id <> doc_id OR root.m <> m")
    if not found.n_repeated:
        return without_ids(docs, gone, gone.count())
    once, many = (docs.join(small(found.repeated, found.n_repeated, 40), "doc_id", how).select(*docs.columns) for how in ("left_anti", "left_semi"))
    single = gone.where("m = 0")
    once = without_ids(once, single, single.count())
    # of ids with several rows those of the right text stay, each once; texts without a set stay as they are
    words = found.signed.where("set_hash IS NOT NULL").join(small(found.repeated, found.n_repeated, 40), "doc_id", "left_semi").select("doc_id", "t").distinct()
    right = found.rows.where("m <> 0 AND root.doc_id = doc_id AND root.m = m").select("doc_id", F.col("m").alias("t"))
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    hashed = many.withColumn(own, F.xxhash64("text"))
    of = lambda t, how: hashed.join(t.select("doc_id", F.col("t").alias(own)), ["doc_id", own], how)
    rank = own + "rank"
    kept = of(right, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", own).orderBy("text"))).where(F.col(rank) == 1)
    return once.unionByName(of(words, "left_anti").select(*docs.columns)).unionByName(kept.select(*docs.columns))
