"""Ground truth and quality figures: ROC and AUC, span precision, recall and granularity over thresholds, accuracies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemmata.operators.corpus import draw
from stemmata.operators.scoring import outlier
from stemmata.operators.spans import overlap
from stemmata.session import Scratch

THRESHOLDS = [k / 20 for k in range(20)]


def atom_truth(atoms: DataFrame, spans: DataFrame) -> DataFrame:
    """Each atom's truth with its sources: (doc_id, atom_num, truth, sources, spans, source_spans, obfuscation).

    ``spans(doc_id, start, end, source_id, source_start, source_end, obfuscation)``; lists are in order of place.
    """
    s = spans.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "source_id", "source_start", "source_end", "obfuscation")
    j = atoms.select("doc_id", "atom_num", "start", "end").join(s, "doc_id", "left")
    hit = F.col("_s").isNotNull() & (F.greatest("_s", "start") < F.least("_e", "end"))  # those two skip nulls
    one = F.when(hit, F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"), "source_id", "source_start", "source_end", "obfuscation"))
    g = j.groupBy("doc_id", "atom_num").agg(F.array_sort(F.collect_list(one)).alias("f"))
    part = lambda *names: F.transform("f", lambda x: x[names[0]] if len(names) == 1 else F.struct(*(x[n].alias(n) for n in names)))
    return g.select(
        "doc_id", "atom_num", (F.size("f") > 0).cast("int").alias("truth"), part("source_id").alias("sources"), part("start", "end").alias("spans"), part("source_start", "source_end").alias("source_spans"), part("obfuscation").alias("obfuscation")
    )


def without_high_obfuscation(truths: DataFrame) -> DataFrame:
    return truths.where(~F.array_contains("obfuscation", "high"))


def roc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr): a point for each distinct confidence of ``scores(actual, confidence)``, the strictest first."""
    group = group or []
    by = scores.groupBy(*group, "confidence").agg(F.sum("actual").alias("p"), F.sum(1 - F.col("actual")).alias("n"))
    run = Window.partitionBy(*group).orderBy(F.desc("confidence"))
    whole = Window.partitionBy(*group)
    share = lambda c: F.sum(c).over(run) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return by.select(*group, F.col("confidence").alias("threshold"), share("n").alias("fpr"), share("p").alias("tpr"))


def auc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(n, positives, auc) of ``scores(actual, confidence)``: equal to the trapezoid area, ties shared; null with one class.

    Scores are first counted by value, so what is sorted is no longer than the number of distinct confidences.
    """
    group = group or []
    by = scores.groupBy(*group, "confidence").agg(F.sum("actual").alias("p"), F.sum(1 - F.col("actual")).alias("q"))
    run = Window.partitionBy(*group).orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    pairs = by.withColumn("below", F.coalesce(F.sum("q").over(run), F.lit(0)))
    g = pairs.groupBy(*group).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return g.select(*group, (F.col("positives") + F.col("negatives")).alias("n"), "positives", (F.col("won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"))


def spans_quality(detected: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """Macro precision and recall, F, granularity and overall score of ``detected`` against ``spans`` in each group.

    Both have (*group, start, end). Recall is the mean over true spans of their covered share, precision the mean over
    detections; an empty side gives null. Spans aren't merged, so overlapping ones count twice. With c detections on a
    true span, granularity is the sum of squares of c over the sum of c, and 1 where nothing overlaps.
    """
    # equal spans are one row with their number: no row needs an id of its own
    d = detected.groupBy(*group, F.col("start").alias("ds"), F.col("end").alias("de")).agg(F.count("*").alias("dm"))
    s = spans.groupBy(*group, F.col("start").alias("ss"), F.col("end").alias("se")).agg(F.count("*").alias("sm"))
    pairs = d.join(s, group).withColumn("o", overlap(F.col("ds"), F.col("de"), F.col("ss"), F.col("se"))).where("o > 0")
    share = lambda hit, size: F.coalesce(hit, F.lit(0)) / F.nullif(size, F.lit(0))
    mean = lambda v, m: F.sum(v * m) / F.sum(F.when(v.isNotNull(), m))
    by_s = pairs.groupBy(*group, "ss", "se").agg(F.sum(F.col("o") * F.col("dm")).alias("o"), F.sum("dm").alias("c"))
    by_d = pairs.groupBy(*group, "ds", "de").agg(F.sum(F.col("o") * F.col("sm")).alias("o"))
    recall = s.join(by_s, [*group, "ss", "se"], "left").groupBy(*group).agg(
        mean(share(F.col("o"), F.col("se") - F.col("ss")), F.col("sm")).alias("recall"), F.sum(F.col("c") * F.col("c") * F.col("sm")).alias("cc"), F.sum(F.col("c") * F.col("sm")).alias("c")
    )
    precision = d.join(by_d, [*group, "ds", "de"], "left").groupBy(*group).agg(mean(share(F.col("o"), F.col("de") - F.col("ds")), F.col("dm")).alias("precision"))
    j = precision.join(recall, group, "full").withColumn("granularity", F.coalesce(F.col("cc") / F.col("c"), F.lit(1.0))).drop("cc", "c")
    f = f_measure(F.col("precision"), F.col("recall"))
    return j.withColumn("f_measure", f).withColumn("overall", overall(F.col("f_measure"), F.col("granularity")))


def f_measure(p: Column, r: Column) -> Column:
    """The harmonic mean; 0 where both are 0, null where one is."""
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def overall(f: Column, granularity: Column) -> Column:
    return f / F.log2(1 + granularity)


def edges(quality: DataFrame) -> DataFrame:
    """Precision 1 where nothing was detected, recall 1 where nothing was to be found: the older reading of empty sides."""
    return quality.withColumn("precision", F.coalesce("precision", F.lit(1.0))).withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def sweep(scores: DataFrame, spans: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, precision, recall, f_measure, granularity, overall): means over documents, nulls aside.

    ``scores(doc_id, start, end, confidence)``: an atom is detected where its confidence is above the threshold. A
    document without any detection at a threshold still counts with what it has.
    """
    t = F.explode(F.array(*map(F.lit, thresholds)))
    detected = scores.select("doc_id", "start", "end", "confidence", t.alias("threshold")).where("confidence > threshold")
    wanted = spans.select("doc_id", "start", "end").join(scores.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "start", "end", t.alias("threshold"))
    q = spans_quality(detected, wanted, ["doc_id", "threshold"])
    every = scores.select("doc_id").distinct().select("doc_id", t.alias("threshold"))
    q = every.join(q, ["doc_id", "threshold"], "left").withColumn("granularity", F.coalesce("granularity", F.lit(1.0)))
    return q.groupBy("threshold").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f_measure", "granularity", "overall")))


def confusion(scores: DataFrame, cut: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """Counts of ``scores(actual, confidence)`` at a cut, with accuracy, precision and recall; null where undefined."""
    hit, real = F.col("confidence") > cut, F.col("actual") == 1
    one = lambda c: F.sum(c.cast("int"))
    g = scores.groupBy(*(group or [])).agg(one(hit & real).alias("true_pos"), one(hit & ~real).alias("false_pos"), one(~hit & ~real).alias("true_neg"), one(~hit & real).alias("false_neg"))
    tp, fp, tn, fn = (F.col(c) for c in ("true_pos", "false_pos", "true_neg", "false_neg"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    return g.select("*", over(tp + tn, tp + fp + tn + fn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"))


def wrong(scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of ``scores`` on the wrong side of the cut, ``kind`` says which, ``how_wrong`` how far they are from the truth."""
    kind = F.when((F.col("confidence") > cut) & (F.col("actual") == 0), "false_pos").when((F.col("confidence") <= cut) & (F.col("actual") == 1), "false_neg")
    return scores.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("how_wrong", F.abs(F.col("actual") - F.col("confidence")))


def source_accuracy(found: DataFrame, truths: DataFrame) -> DataFrame:
    """Over plagiarised atoms: how many name a true source, of those that name any, and of all.

    ``found`` is the first candidate of each atom (``search.best``), ``truths(doc_id, atom_num, truth, sources)``.
    """
    j = truths.where("truth = 1").join(found.select("doc_id", "atom_num", "source_id"), ["doc_id", "atom_num"], "left")
    right = F.coalesce(F.array_contains("sources", F.col("source_id")), F.lit(False)).cast("int")
    g = j.agg(F.count("*").alias("plagiarised"), F.count("source_id").alias("named"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"))
    return g.select("*", (F.col("correct") / F.nullif("named", F.lit(0))).alias("source_accuracy"), (F.col("correct") / F.nullif("plagiarised", F.lit(0))).alias("true_source_accuracy"))


def least_passages(scores: DataFrame, least: int = 7) -> DataFrame:
    """Scores of documents with ``least`` passages or more."""
    return scores.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("_n") >= least).drop("_n")


def transitions(truths: DataFrame) -> DataFrame:
    """(previous, next, n, share): how often passages of one truth follow those of another in a document."""
    w = Window.partitionBy("doc_id").orderBy("atom_num")
    moves = truths.select(F.lag("truth").over(w).alias("previous"), F.col("truth").alias("next")).where("previous IS NOT NULL").groupBy("previous", "next").agg(F.count("*").alias("n"))
    return moves.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("previous")))


def t_statistics(long: DataFrame, block: int = 2048) -> DataFrame:
    """Welch's t of each feature between every two documents: (feature, doc_a, doc_b, t, freedom); null below two passages.

    The documents are cut into blocks; each two blocks of a feature are a cell of their own, so a task holds one block, whatever their number.
    """
    s = Scratch(long.sparkSession, "moments").keep(long.groupBy("feature", "doc_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")), "table")
    blocks = -(-s.select("doc_id").distinct().count() // block) or 1
    s = s.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # block g meets each other block once: as a in the cells (g, g..), as b in the cells (..g, g)
    a = s.select("feature", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "m", "v")), F.col("g").alias("i"), F.explode(F.sequence("g", F.lit(blocks - 1))).alias("j"))
    b = s.select("feature", *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "m", "v")), F.explode(F.sequence(F.lit(0), "g")).alias("i"), F.col("g").alias("j"))
    if blocks > 1:  # as many tasks as cells, up to 4,000: the moments are small, what is made of them isn't
        a, b = (x.repartition(min(4000, 5 * blocks * (blocks + 1) // 2), "feature", "i", "j") for x in (a, b))
    pairs = a.hint("shuffle_hash").join(b, ["feature", "i", "j"]).where("i < j AND doc_id_x <> doc_id_y OR i = j AND doc_id_x < doc_id_y")
    first = F.col("doc_id_x") < F.col("doc_id_y")
    side = lambda k, x, y: [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{k}") for c in ("doc_id", "n", "m", "v")]
    t, freedom = _welch()
    return pairs.select("feature", *side("a", "x", "y"), *side("b", "y", "x")).select("feature", F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), t.alias("t"), freedom.alias("freedom"))


def _welch() -> tuple[Column, Column]:
    """t and its degrees of freedom from the columns n, m and v of sides a and b."""
    va, vb = F.col("v_a") / F.nullif("n_a", F.lit(0)), F.col("v_b") / F.nullif("n_b", F.lit(0))
    t = (F.col("m_a") - F.col("m_b")) / F.nullif(F.sqrt(va + vb), F.lit(0.0))
    freedom = F.pow(va + vb, F.lit(2)) / F.nullif(va * va / F.nullif(F.col("n_a") - 1, F.lit(0)) + vb * vb / F.nullif(F.col("n_b") - 1, F.lit(0)), F.lit(0.0))
    return t, freedom


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by its continued fraction, on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c = np.ones_like(x)
        d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
        h = d.copy()
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def _p_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, v = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 1))
        some = ~(np.isnan(t) | np.isnan(v))
        p = np.full(len(t), np.nan)
        if some.any():
            p[some] = _incomplete_beta(v[some] / 2, np.full(some.sum(), 0.5), v[some] / (v[some] + t[some] ** 2))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, mask=~some)], [*batch.schema.names, "p"])


def with_p_values(tests: DataFrame) -> DataFrame:
    """Rows that end in (t, freedom) with ``p``, the two-sided probability of Student's t; null where either is."""
    return tests.mapInArrow(_p_values, T.StructType([*tests.schema.fields, T.StructField("p", T.DoubleType())]))


def same_document(long: DataFrame, seed: int = 1) -> DataFrame:
    """(feature, doc_id, t, freedom): Welch's t between two samples of one document, its passages split by a seeded draw; the counterpart of ``t_statistics``."""
    halves = long.withColumn("_h", F.when(draw(seed, "doc_id", "atom_num") < 0.5, F.lit(0)).otherwise(F.lit(1)))
    both = halves.groupBy("feature", "doc_id").pivot("_h", [0, 1]).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    renamed = both.select("feature", "doc_id", *(F.col(f"{k}_{c}").alias(f"{c}_{x}") for k, x in ((0, "a"), (1, "b")) for c in ("n", "m", "v")))
    t, freedom = _welch()
    return renamed.select("feature", "doc_id", t.alias("t"), freedom.alias("freedom"))


def pairwise_aucs(long: DataFrame, truths: DataFrame, features: list[str]) -> DataFrame:
    """(feature_a, feature_b, auc): how well the outlier score of each two features alone finds ``truths(doc_id, atom_num, actual)``; ``auc_bands`` reads it.

    One plan: each value is repeated for the pairs that it belongs to, and the score runs on all at once.
    """
    pairs = list(combinations(sorted(features), 2))
    own = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    each = long.where(F.col("feature").isin(features)).withColumn("pair", own).where("feature IN (pair.a, pair.b)")
    scored = outlier(each.select(F.struct("doc_id", "pair").alias("doc_id"), "atom_num", "feature", "value"))
    flat = scored.select("doc_id.doc_id", F.col("doc_id.pair.a").alias("feature_a"), F.col("doc_id.pair.b").alias("feature_b"), "atom_num", F.round("confidence", 9).alias("confidence"))
    return auc(flat.join(truths.select("doc_id", "atom_num", "actual"), ["doc_id", "atom_num"]), ["feature_a", "feature_b"]).select("feature_a", "feature_b", "auc")


def overlap_rows(detected: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, covered): true spans and detections of each document in order, with how many places the other kind covers of each; what an overlap plot draws."""
    d, s = (x.select("doc_id", "start", "end").distinct() for x in (detected, spans))
    out = None
    for kind, one, other in (("detected", d, s), ("true", s, d)):
        o = other.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
        both = one.join(o, "doc_id", "left").withColumn("o", overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")))
        rows = both.groupBy("doc_id", "start", "end").agg(F.sum("o").alias("covered")).select("doc_id", F.lit(kind).alias("kind"), "start", "end", "covered")
        out = rows if out is None else out.unionByName(rows)
    return out


def auc_bands(aucs: DataFrame) -> DataFrame:
    """(feature_a, feature_b, auc) with the mean and deviation of all, z, and its band from -2 to 2."""
    s = aucs.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"))
    z = (F.col("auc") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    band = F.when(F.col("z") >= 2, 2).when(F.col("z") >= 1, 1).when(F.col("z") > -1, 0).when(F.col("z") > -2, -1).otherwise(-2)
    return aucs.crossJoin(F.broadcast(s)).withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("band", band)


def gain(aucs: DataFrame) -> DataFrame:
    """The mean of AUC with cheating less that without, over settings that have both: ``aucs(setting, cheating, auc)``."""
    a = aucs.where("cheating").select("setting", F.col("auc").alias("_a"))
    b = aucs.where("NOT cheating").select("setting", F.col("auc").alias("_b"))
    return a.join(b, "setting").agg(F.count("*").alias("settings"), F.avg(F.col("_a") - F.col("_b")).alias("gain"))


def corpus_statistics(docs: DataFrame, spans: DataFrame, long_chars: int = 35_000) -> DataFrame:
    """One row: documents, share with plagiarism, of at least ``long_chars``; five numbers and mean of lengths and, over documents that have any, of
    plagiarised characters; plagiarised share of all text, paragraphs and their number a document. Overlapping spans count twice."""
    per = spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("plag"))
    paragraphs = F.size(F.split(F.regexp_replace("text", r"[ \t\n\f\r]*\n\n+[ \t\n\f\r]*$", ""), r"[ \t\n\f\r]*\n\n+[ \t\n\f\r]*", -1))
    j = docs.select("doc_id", F.length("text").alias("size"), F.when(F.col("text") == "", 0).otherwise(paragraphs).alias("paragraphs")).join(per, "doc_id", "left")
    q = lambda c, p: F.percentile(c, F.lit(p))
    five = lambda c, x="": [F.min(c).alias(f"{x}min"), q(c, 0.25).alias(f"{x}q1"), q(c, 0.5).alias(f"{x}median"), q(c, 0.75).alias(f"{x}q3"), F.max(c).alias(f"{x}max"), F.avg(c).alias(f"{x}mean")]
    return j.agg(
        F.count("*").alias("documents"), F.avg(F.col("plag").isNotNull().cast("int")).alias("share_with_plag"), F.avg((F.col("size") >= long_chars).cast("int")).alias("share_long"),
        *five("size"), *five("plag", "plag_"), (F.coalesce(F.sum("plag"), F.lit(0)) / F.sum("size")).alias("plag_share"), F.sum("paragraphs").alias("paragraphs"), F.avg("paragraphs").alias("paragraphs_mean"),
    )
