"""Scores of passages within their own document, from (doc_id, atom_num, feature, value).

``outlier`` and ``median_simple`` are window functions: one shuffle by document serves all of them. The
clusterings need a document's vectors together and run in numpy over sorted batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions import cluster as cl
from stemmata.functions.network import Network
from stemmata.session import prepare

IMPURITY, LEAST_PROB = 0.2, 1e-30


def outlier(long: DataFrame, ignore: int = 1, at_median: bool = False) -> DataFrame:
    """(doc_id, atom_num, confidence): the naive Bayes product over features of uniform against normal density.

    The normal is fitted to the document's values without the ``ignore`` least and greatest. A feature that is
    constant (to 1e-12) says nothing, nor does a value one to two deviations (give or take rounding) from the centre; a passage that no feature
    speaks of gets 0.2, and so do all passages of documents with no value left to fit.
    """
    whole = Window.partitionBy("doc_id", "feature")
    ranked = long.repartition("doc_id").withColumn("n", F.count("*").over(whole)).withColumn("r", F.row_number().over(whole.orderBy("value", "atom_num")))
    kept = F.when((F.col("r") > ignore) & (F.col("r") <= F.col("n") - ignore), F.col("value"))
    s = ranked.select(
        "doc_id", "atom_num", "value", F.avg(kept).over(whole).alias("mean"), F.stddev_pop(kept).over(whole).alias("sd"), F.min("value").over(whole).alias("low"), F.max("value").over(whole).alias("high"),
        F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("value"))).over(whole).alias("median"),
    )
    off = F.abs(F.col("value") - F.col("median" if at_median else "mean"))
    normal = F.exp(-0.5 * F.pow(off / F.col("sd"), 2)) / (F.col("sd") * float(np.sqrt(2 * np.pi)))
    normal = F.when(normal > 0, normal).otherwise(LEAST_PROB)
    uniform = F.when(F.col("high") == F.col("low"), 1.0).otherwise(1 / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    speaks = (F.col("sd") > 1e-12) & ~off.between(F.col("sd") * (1 - 1e-9), F.col("sd") * (2 + 1e-9))
    return s.withColumn("c", F.when(speaks, F.ln(uniform / (uniform + normal)))).groupBy("doc_id", "atom_num").agg(F.coalesce(F.exp(F.sum("c")), F.lit(IMPURITY)).alias("confidence"))


def median_simple(long: DataFrame) -> DataFrame:
    """(doc_id, atom_num, feature, confidence): distance from the document's median over the largest; 0 where constant."""
    whole = Window.partitionBy("doc_id", "feature")
    d = long.repartition("doc_id").withColumn("d", F.abs(F.col("value") - F.percentile("value", F.lit(0.5)).over(whole)))
    top = F.max("d").over(whole)
    return d.select("doc_id", "atom_num", "feature", F.when(top > 0, F.col("d") / top).otherwise(0.0).alias("confidence"))


def vectors(long: DataFrame) -> DataFrame:
    """(doc_id, atom_num, vector): values in order of the features' names."""
    return long.groupBy("doc_id", "atom_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda p: p["value"]).alias("vector"))


def _runs(batches: Iterator[pa.RecordBatch], hows: dict[str, Callable[[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, atom_num, vector) in order to (doc_id, atom_num, a score by each of ``hows``); holds one document at a time."""
    ids: list[int | None] = []
    nums: list[int] = []
    vectors: list[np.ndarray] = []
    out: list[list] = [[], [], *([] for _ in hows)]

    def score() -> None:
        x = np.nan_to_num(np.stack(vectors).astype(float))
        out[0] += ids
        out[1] += nums
        for column, how in zip(out[2:], hows.values()):
            column.append(how(x))
        ids.clear(), nums.clear(), vectors.clear()

    def flush() -> pa.RecordBatch:
        scores = [pa.array(np.concatenate([np.zeros(0), *c]), pa.float64()) for c in out[2:]]
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *scores], ["doc_id", "atom_num", *hows])
        for c in out:
            c.clear()
        return done

    for batch in batches:
        v = batch.column(2)
        flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_pylist()
        for doc, num, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:]):
            if ids and doc != ids[-1]:
                score()
            ids.append(doc), nums.append(num), vectors.append(flat[a:b])
        if out[0]:
            yield flush()
    if ids:
        score()
        yield flush()


def _by_document(long: DataFrame, hows: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Each of ``hows`` on each document's vectors, in order of its passages: one shuffle by document, one pass over Arrow batches of many of them."""
    prepare(long.sparkSession)
    ordered = vectors(long.repartition("doc_id")).sortWithinPartitions("doc_id", "atom_num")
    return ordered.mapInArrow(partial(_runs, hows=hows), ", ".join(["doc_id bigint, atom_num int", *(f"{name} double" for name in hows)]))


def clusters(long: DataFrame, methods: list[str], k: int = 2) -> DataFrame:
    """(doc_id, atom_num, a column for each of ``methods``): clusterings and the hidden Markov model, all in one pass."""
    for method in methods:
        if method not in cl.METHODS:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(cl.METHODS)}")
    return _by_document(long, {m: partial(cl.METHODS[m], k=k) for m in methods})


def cluster(long: DataFrame, method: str, k: int = 2, **how: object) -> DataFrame:
    """Confidences by ``method``: outlier, median_simple (one feature), kmeans, kmedians, median_kmeans, agglom, hmm."""
    if method == "outlier":
        return outlier(long, **how)  # type: ignore[arg-type]
    if method == "median_simple":
        return median_simple(long).select("doc_id", "atom_num", "confidence")
    if method not in cl.METHODS:
        raise ValueError(f"unknown method {method!r}; one of outlier, median_simple, {', '.join(cl.METHODS)}")
    return _by_document(long, {"confidence": partial(cl.METHODS[method], k=k, **how)})


def combine_confidences(long: DataFrame, weights: list[float]) -> DataFrame:
    """One k-means score for each feature (in order of names), added with weights."""
    return _by_document(long, {"confidence": partial(cl.score_combined, weights=np.array(weights))})


def network_confidences(long: DataFrame, network: Network) -> DataFrame:
    """The output of a trained feed-forward network for each passage, in SQL array functions: the weights are literals."""
    layer = lambda x, w, b: F.array(*(F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, c: a * c), F.lit(float(c0)), lambda acc, v: acc + v) for row, c0 in zip(w.tolist(), b.tolist())))
    v = vectors(long).withColumn("hidden", F.transform(layer(F.col("vector"), network.w1, network.b1), lambda z: 1 / (1 + F.exp(-z))))
    return v.select("doc_id", "atom_num", layer(F.col("hidden"), network.w2, network.b2)[0].alias("confidence"))


def rescale(scores: DataFrame) -> DataFrame:
    """Confidences over the document's largest, after a negative minimum is lifted to 0; all alike at 0: 0.2."""
    whole = Window.partitionBy("doc_id")
    lift = F.least(F.min("confidence").over(whole), F.lit(0.0))
    top = F.max("confidence").over(whole) - lift
    return scores.withColumn("confidence", F.when(top == 0, IMPURITY).otherwise((F.col("confidence") - lift) / F.nullif(top, F.lit(0.0))))


def distribution(long: DataFrame) -> DataFrame:
    """(feature, n, min, q1, median, q3, max, mean) of each feature over all passages."""
    p = lambda q: F.percentile("value", F.lit(q))
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("min"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def unmask(long: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """(removed, doc_id, share): passages above ``threshold`` without each feature in turn, and with all (``control``).

    One plan: each value is repeated for every feature that is left out, and the outlier score runs on all at once.
    """
    sets = F.explode(F.array(F.lit("control"), *map(F.lit, features)))
    each = long.withColumn("removed", sets).where("removed <> feature")
    # a document and a removed feature together are one document for the scorer
    pair = each.withColumn("pair", F.struct("doc_id", "removed"))
    scored = outlier(pair.select(F.col("pair").alias("doc_id"), "atom_num", "feature", "value"))
    share = F.avg((F.col("confidence") > threshold).cast("int"))
    return scored.groupBy(F.col("doc_id.removed").alias("removed"), F.col("doc_id.doc_id").alias("doc_id")).agg(share.alias("share"))
