"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

In every stage all columns of the documents pass through, whatever their names; texts of any length are read whole; an empty table gives an
empty one; rows with a null doc_id or a null or empty text stay, but for what their stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemmata.llm import byte_bpe, decontam, near_dup, quality, secrets
from stemmata.session import Scratch, prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, doesn't reject.

    Null texts stay unjudged, empty ones are judged; a score equal to the threshold is enough; repeated rows share a fate; without labels all stay.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id.

    Null and blank texts and null ids stay; of equal rows one stays; rows with one doc_id and unlike texts are documents of their own.
    """
    return near_dup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no ``benchmark`` item.

    Null texts and null ids stay; all rows of a doc_id go if one matches; items without a word match nothing.
    """
    return decontam.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of the rule that found them; overlapping ones as one, by the first. Repeated rows are redacted alike."""
    return secrets.redact_secrets(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: null for a null text, none for an empty one; rows repeat as they come, null ids stay null."""
    return byte_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level bpe", byte_level_bpe),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``; of what the stages returned only the last table stays in the shared folder."""
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(prepare(spark), "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
