"""Intrinsic and extrinsic evidence together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.operators.evaluate import auc

EPS = 0.001


def power_mean(x: Column, y: Column, p: float) -> Column:
    return F.pow((F.pow(x + EPS, F.lit(p)) + F.pow(y + EPS, F.lit(p))) / 2, F.lit(1 / p))


MEANS = {
    "geometric": lambda x, y: F.sqrt((x + EPS) * (y + EPS)),
    "arithmetic": lambda x, y: (x + y) / 2,
    "max": F.greatest,
    "min": F.least,
    "sum": lambda x, y: x + y,
}


def combine(intrinsic: DataFrame, extrinsic: DataFrame, how: str = "arithmetic") -> DataFrame:
    """(doc_id, atom_num, intrinsic, extrinsic, confidence) of the atoms that both sides scored; ``power<p>`` is a power mean."""
    i = intrinsic.select("doc_id", "atom_num", F.col("confidence").alias("intrinsic"))
    e = extrinsic.select("doc_id", "atom_num", F.col("confidence").alias("extrinsic"))
    if how.startswith("power"):
        value = power_mean(F.col("intrinsic"), F.col("extrinsic"), float(how[5:]))
    elif how in MEANS:
        value = MEANS[how](F.col("intrinsic"), F.col("extrinsic"))
    else:
        raise ValueError(f"unknown mean {how!r}; one of power<p>, {', '.join(MEANS)}")
    return i.join(e, ["doc_id", "atom_num"]).withColumn("confidence", value)


def three_aucs(combined: DataFrame, truths: DataFrame) -> DataFrame:
    """(evidence, n, positives, auc) of the intrinsic, the extrinsic and the combined confidences against the same truth."""
    j = combined.join(truths.select("doc_id", "atom_num", F.col("truth").alias("actual")), ["doc_id", "atom_num"])
    sides = F.array(*(F.struct(F.lit(n).alias("evidence"), F.col(c).alias("confidence")) for n, c in (("intrinsic", "intrinsic"), ("extrinsic", "extrinsic"), ("combined", "confidence"))))
    return auc(j.select("actual", F.explode(sides).alias("s")).select("actual", "s.evidence", "s.confidence"), ["evidence"])


def analyze(scores: DataFrame, least: float = 0.85) -> DataFrame:
    """The passages above ``least``, the most suspicious first."""
    return scores.where(F.col("confidence") > least).orderBy(F.desc("confidence"), "doc_id", "atom_num")
