"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemmata.llm import ann, byte_bpe, chat_format, decontam, licenses, near_dup, quality, secrets, toxicity, url_lists
from stemmata.session import prepare


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn of ``conversations``."""
    return chat_format.expand(_read(spark, sf_dir, "conversations"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all ``documents``."""
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all ``documents``."""
    return byte_bpe.encode(_read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``, by a model of ``labels``."""
    docs = _read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, links and copies of each of ``documents`` that has any."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``, by a model of ``labels``."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each of ``pages``, by the lists as of its fetch time."""
    pages = _read(spark, sf_dir, "pages")
    return url_lists.as_of(url_lists.dated_captures(pages), url_lists.dated_entries(pages))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all ``embeddings``, of those with an id divisible by 100."""
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of all ``benchmark`` items in all ``documents``."""
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence paragraphs of all ``documents``."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


_ALL = (op1_chat_format, op2_secret_scan, op3_byte_bpe, op4_quality_classifier, op5_minhash_dedup, op6_toxicity, op7_url_filter, op8_nearest_neighbours, op9_decontamination, op10_license_scan)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op1_chat_format": chat_format.SQL, "op7_url_filter": url_lists.SQL}
