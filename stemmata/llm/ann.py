"""Approximate nearest neighbours: cross-polytope hashing with fast Hadamard pseudo-rotations and multiprobe.

A unit vector, padded with zeros to a power of two, goes through three rounds of random signs and a Hadamard transform;
its hash is the signed axis nearest to the result. A bucket joins as many such hashes as make its expected
size ``BUCKET`` vectors: the last one may use fewer axes, and there is always one. Every vector is stored in its nearest
bucket of each table; a query asks there and in the next ones by closeness. What is stored in a bucket is compared with all that
ask there by one matrix product in float64, so reranking is exact, and the best ``k`` of each bucket are merged.

How many tables and probes that takes depends on how far the neighbours are. It is measured: the exact neighbours of ``TUNE_ROWS``
entries are found by one pass over all vectors; for each number of tables the number of probes follows at which ``TARGET``
of those neighbours share a bucket with their entry, and the cheapest pair is taken: a stored row costs as much as
``STORE_COST`` comparisons.

Queries are the rows with an id divisible by ``EVERY``, or those that the caller names; all rows are stored. A bucket that holds
more than ``BLOCK_ROWS`` rows, or is asked by more than ``BLOCK_ASKS``, is a grid of blocks, each a group of its own in the
shuffle: a task never holds more than one block's stored rows, whatever share of all rows one bucket has, and none is left out.

Vectors that are equal are one entry that carries its k + 1 smallest ids; with ties broken by
id no other copy can be among anyone's k nearest, so thousands of copies cost no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemmata.session import Scratch, prepare, small

K, EVERY, BUCKET, SEED = 10, 100, 400, 5
TUNE_ROWS, TARGET, MAX_PROBES, MAX_TABLES, STORE_COST = 256, 0.97, 1024, 32, 200
BLOCK, BLOCK_ROWS, BLOCK_ASKS = 2048, 8192, 8192
HASHED = "size int, tab int, bucket bigint, ask boolean, uid bigint, vec binary"


class Plan(NamedTuple):
    """For one length of vector: the axes of each hash of a bucket, the tables, and the probes of a query in each."""

    axes: list[int]
    tables: int
    probes: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d, dtype=x.dtype)


def rotate(x: np.ndarray, table: int, part: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, table, part, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], x.dtype), x.shape[1]))
    return x


def shape(n: int, width: int, bucket: int = BUCKET) -> list[int]:
    """How many axes each hash of a bucket looks at, so that n vectors make about n / bucket buckets; one axis at least."""
    wanted, axes = n / bucket, []
    while wanted >= 2:
        axes.append(int(min(width, 1 << int(np.log2(wanted / 2)))))
        wanted /= 2 * axes[-1]
    return axes or [1]


def buckets(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """For each row the ``probes`` nearest buckets (fewer if there are fewer), nearest first."""
    code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float64)
    for part, width in enumerate(axes):
        y = rotate(x, table, part)[:, :width]
        far = -np.concatenate([y, -y], 1)
        take = min(probes, far.shape[1])
        near = np.argsort(far, axis=1, kind="stable")[:, :take]
        extra = np.take_along_axis(far, near, 1)
        extra = extra - extra[:, :1]
        code = (code[:, :, None] * (2 * width) + near[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + extra[:, None, :].astype(np.float64)).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
    return code


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 1 << int(np.ceil(np.log2(x.shape[1])))))
    out[:, : x.shape[1]] = x
    return out


def _hash(batches: Iterator[pa.RecordBatch], plans: dict[int, Plan], ask: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (uid, embedding) to their buckets: the nearest of each table, or those where a query asks."""
    names = [x.split()[0] for x in HASHED.split(", ")]
    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths(), np.int64)
        for size in np.unique(sizes).tolist():
            rows, plan = batch.filter(pa.array(sizes == size)), plans[size]
            step = max(1, BLOCK // (plan.probes if ask else 1))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                raw = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, size)
                x, uid = padded(unit(raw)), np.asarray(part.column(0))
                vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * np.dtype(kind).itemsize), len(x), [None, pa.py_buffer(raw.astype(kind).tobytes())]).cast(pa.binary())
                for table in range(plan.tables):
                    code = buckets(x, table, plan.axes, plan.probes if ask else 1)
                    n, m = code.shape
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n * m, size, np.int32)), pa.array(np.full(n * m, table, np.int32)), pa.array(code.T.ravel()),
                            pa.array(np.full(n * m, ask)), pa.array(np.tile(uid, m)), vec.take(pa.array(np.tile(np.arange(n), m))),
                        ],
                        names,
                    )


def _exact(batches: Iterator[pa.RecordBatch], size: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each asked entry among a task's vectors, with those vectors."""
    best, sims, there = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -2.0), np.zeros((len(ids), k, size))
    for batch in batches:
        raw = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, size)
        if not len(raw):
            continue
        uid = np.asarray(batch.column(0))
        near, s = nearest(vectors, ids, unit(raw), uid, k)
        order = np.argsort(uid)
        found = raw[order[np.minimum(np.searchsorted(uid[order], near), len(uid) - 1)]]
        both, which, rows = np.concatenate([sims, s], 1), np.concatenate([best, near], 1), np.concatenate([there, found], 1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :k]
        sims, best, there = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1), np.take_along_axis(rows, top[:, :, None], 1)
    some = best >= 0
    flat = there[some]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, size, dtype=np.int32)), pa.array(flat.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[some.ravel()]), pa.array(sims[some]), lists], ["asked", "sim", "embedding"])


def tune(entries: DataFrame, queries: float, k: int, bucket: int, rows: int = TUNE_ROWS, target: float = TARGET) -> dict[int, Plan]:
    """A plan for each length of vector by which ``target`` of the nearest pairs of ``rows`` entries meet.

    ``queries`` is the share of rows that ask. ``rows`` bounds what comes to the driver; all vectors are compared with them.
    """
    out = {}
    for size, n in [(r["size"], r["n"]) for r in entries.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).toLocalIterator()]:
        of_size = entries.where(F.size("embedding") == size).select("uid", "embedding")
        chosen = of_size.orderBy(F.xxhash64("uid"), "uid").limit(rows).toArrow()
        ids, x = chosen["uid"].to_numpy(), unit(np.asarray(chosen["embedding"].to_pylist(), np.float64))
        q = padded(x)
        axes = shape(n, q.shape[1], bucket)
        near = of_size.mapInArrow(partial(_exact, size=size, ids=ids, vectors=x, k=k), "asked bigint, sim double, embedding array<double>")
        near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("sim")))).where(F.col("_rank") <= k).select("asked", "embedding").toArrow()
        if not near.num_rows:
            out[size] = Plan(axes, 1, 1)
            continue
        order = np.argsort(ids)
        mine = order[np.searchsorted(ids[order], near["asked"].to_numpy())]
        stored = padded(unit(np.asarray(near["embedding"].to_pylist(), np.float64)))
        # the probe at which each pair meets, in the table where that is first
        first, best = np.full(len(mine), MAX_PROBES), None
        for table in range(MAX_TABLES):
            asked, own = buckets(q, table, axes, MAX_PROBES), buckets(stored, table, axes, 1)
            for a in range(0, len(mine), BLOCK):
                same = asked[mine[a : a + BLOCK]] == own[a : a + BLOCK]
                first[a : a + BLOCK] = np.minimum(first[a : a + BLOCK], np.where(same.any(axis=1), same.argmax(axis=1), MAX_PROBES))
            probes = int(np.sort(first)[int(np.ceil(target * len(first))) - 1]) + 1
            cost = (table + 1) * (STORE_COST + queries * min(probes, asked.shape[1]) * min(bucket, n))
            if probes <= MAX_PROBES and (best is None or cost < best[0]):
                best = (cost, Plan(axes, table + 1, probes))
            elif best is not None and (table + 1) * STORE_COST > best[0]:
                break
        if best is None:
            raise ValueError(f"{MAX_TABLES} tables of {MAX_PROBES} probes don't reach {target} of the neighbours of vectors of length {size}")
        out[size] = best[1]
    return out


def nearest(asked: np.ndarray, ask_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k stored vectors nearest to each asked one but itself; -1 where there are fewer."""
    take = min(k, len(ids))
    order = np.argsort(ids, kind="stable")
    stored, ids = stored[order], ids[order]
    best, sims = np.full((len(asked), take), -1, np.int64), np.full((len(asked), take), -2.0)
    for a in range(0, len(asked), BLOCK):
        own = ask_ids[a : a + BLOCK]
        for b in range(0, len(ids), 4 * BLOCK):
            s = np.round(asked[a : a + BLOCK] @ stored[b : b + 4 * BLOCK].T, 9)
            s[own[:, None] == ids[None, b : b + 4 * BLOCK]] = -2.0
            if s.shape[1] > take:  # all that reach the k-th value, ties too
                floor = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                most = int((s >= floor[:, None]).sum(axis=1).max())
                near = np.argsort(-s, axis=1, kind="stable")[:, :take] if most > 4 * take else np.sort(np.argpartition(-s, most - 1, axis=1)[:, :most], axis=1)
            else:
                near = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            both = np.concatenate([sims[a : a + BLOCK], np.take_along_axis(s, near, 1)], 1)
            which = np.concatenate([best[a : a + BLOCK], ids[b + near]], 1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :take]  # blocks come in order of id: ties keep it
            sims[a : a + BLOCK], best[a : a + BLOCK] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
    best[sims <= -2.0] = -1
    return best, sims


def _search(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, the stored ones of each first; a block may span batches, and its queries pass by."""
    names = ["uid", "id", "sim"]
    now: tuple[int, ...] | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c), np.int64) for c in range(5)], 1)
        ask = batch.column(5).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (ask[1:] != ask[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if now != tuple(key[a]):
                now, held = tuple(key[a]), []
            ids = np.asarray(batch.column(6).slice(a, b - a))
            x = unit(np.frombuffer(b"".join(batch.column(7).slice(a, b - a).to_pylist()), kind).reshape(b - a, -1))
            if not ask[a]:
                held.append((ids, x))
            elif held:
                if len(held) > 1:
                    held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                best, sims = nearest(x, ids, held[0][1], held[0][0], k)
                some = best >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])[some.ravel()]), pa.array(best[some]), pa.array(sims[some])], names)


def _blocks(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Both with (si, qi), the block of each row: stored rows are cut by si and come with every qi of their bucket, queries the other way."""
    key = ["size", "tab", "bucket"]
    load = stored.select(*key, F.lit(1).alias("s"), F.lit(0).alias("q")).unionByName(asked.select(*key, F.lit(0).alias("s"), F.lit(1).alias("q"))).groupBy(*key).agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    cut = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    hot = load.where(f"s > {BLOCK_ROWS} OR q > {BLOCK_ASKS}").select(*key, F.greatest(cut("s", BLOCK_ROWS), F.lit(1)).alias("_s"), F.greatest(cut("q", BLOCK_ASKS), F.lit(1)).alias("_q"))
    n = hot.count()
    parts = []
    for df, own, other, o, p in ((stored, "si", "qi", "_s", "_q"), (asked, "qi", "si", "_q", "_s")):
        j = df.join(small(hot, n, 48), key, "left") if n else df.withColumns({"_s": F.lit(1), "_q": F.lit(1)})
        many = F.sequence(F.lit(0), F.coalesce(p, F.lit(1)) - 1)
        parts.append(j.withColumn(own, F.pmod(F.xxhash64("uid"), F.coalesce(o, F.lit(1))).cast("int")).withColumn(other, F.explode(many)).select(*key, "si", "qi", "ask", "uid", "vec"))
    return parts[0].unionByName(parts[1])


def neighbours(vectors: DataFrame, queries: Column | None = None, k: int = K, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the ``k`` nearest by cosine, among all rows of ``vectors(vec_id, embedding)``, of each query.

    ``queries`` is a condition on ``vec_id``: divisible by ``EVERY`` if not given.
    Similarities are rounded to 6 places, ties go to the smaller id (as do those within a bucket at 9 places). A vector is its own neighbour in no case.
    Null ids, null and empty vectors, and vectors that hold a null, NaN or infinity or have no direction are left out, as queries too; vectors of
    different lengths aren't compared. Of rows that repeat a vec_id the least vector counts. Where there are
    fewer than k others, or the buckets hold fewer, the rest is missing. An empty table gives an empty result. A vector of any
    length is taken whole. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark, "ann")
    asks = F.col("vec_id") % EVERY == 0 if queries is None else queries
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, e -> e IS NULL OR isnan(e) OR abs(e) = double('Infinity')) AND exists(embedding, e -> e <> 0)")
    v = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # of equal vectors the k + 1 smallest ids: each task passes on no more of them
    first = v.withColumn("_rank", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_rank") <= k + 1)
    same = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    same = scratch.keep(same.select(F.col("ids")[0].alias("uid"), "embedding", "ids"), "same")
    asked = scratch.keep(v.where(asks).join(same, "embedding").select("vec_id", "uid", F.size("embedding").alias("size")), "asked")
    entries = same.select("uid", "embedding")
    total, n_asked = same.count(), asked.count()
    plans = tune(entries, n_asked / max(1, total), k, bucket)
    ask_rows = entries.join(asked.select("uid").distinct(), "uid", "left_semi")
    hashed = lambda df, ask: df.mapInArrow(partial(_hash, plans=plans, ask=ask, kind=kind), HASHED)
    block = ["size", "tab", "bucket", "si", "qi"]
    rows = _blocks(hashed(entries, False), hashed(ask_rows, True)).repartition(*block).sortWithinPartitions(*block, "ask")
    found = rows.mapInArrow(partial(_search, k=k, kind=kind), "uid bigint, id bigint, sim double")
    found = found.groupBy("uid", "id").agg(F.round(F.max("sim"), 6).alias("s"))
    near = found.withColumn("_rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("s"), "id"))).where(F.col("_rank") <= k)
    # each neighbour's ids, and the query's own copies before them; of them the first k + 1
    ids = same.select(F.col("uid").alias("id"), "ids")
    near = near.select("uid", "id", "s").unionByName(asked.select("uid", F.col("uid").alias("id"), F.lit(1.0).alias("s")).distinct())
    copies = near.join(ids, "id").select("uid", F.explode(F.transform("ids", lambda i: F.struct((-F.col("s")).alias("s"), i.alias("id")))).alias("n"))
    lists = copies.groupBy("uid").agg(F.array_sort(F.collect_list("n")).alias("near"))  # at most (k + 1) ** 2
    top = F.slice(F.filter("near", lambda n: n.id != F.col("vec_id")), 1, k)
    each = asked.select("vec_id", "uid").join(lists, "uid").select("vec_id", F.posexplode(top).alias("rank", "n"))
    return each.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), (-F.col("n.s")).alias("similarity"))
