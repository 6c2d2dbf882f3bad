"""Corpora: splits, selections and samples of suspects and their sources. Seeded by hashing, so a row's place never depends on others' order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.session import Scratch


def draw(seed: int, *key: str) -> Column:
    """A number in [0, 1) for each key: md5, so that any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def ranked(df: DataFrame, order: list[str], what: str | None = None) -> DataFrame:
    """``df`` with ``rank``, from 1 in the given order, and with ``run``, the sum of column ``what`` up to each row, if named.

    Rows are sorted in ranges, numbered in each, and raised by what the ranges before hold: no task sees more than one range. The
    ranges are written, so a task that runs again numbers alike. ``order`` must tell all rows apart.
    """
    parts = Scratch(df.sparkSession, "ranked").keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "table")
    value = F.coalesce(F.col(what), F.lit(0)) if what else F.lit(0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_v")).select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_v")))
    here = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(sums), "_part").withColumn("rank", (F.row_number().over(here) + F.col("_n")).cast("bigint"))
    if what:
        out = out.withColumn("run", F.sum(value).over(here) + F.col("_v"))
    return out.drop("_part", "_n", "_v")


def split(docs: DataFrame, share: float = 0.7, seed: int = 1) -> DataFrame:
    """``docs`` with ``part``: ``training`` for about ``share`` of the documents, else ``test``. No shuffle and no order."""
    return docs.withColumn("part", F.when(draw(seed, "doc_id") < share, "training").otherwise("test"))


def exact_split(docs: DataFrame, share: float = 0.7, seed: int = 1) -> DataFrame:
    """As ``split``, with exactly the first ``floor(share * n)`` of the seeded order in training."""
    keyed = docs.select("doc_id").distinct().withColumn("_u", draw(seed, "doc_id"))
    placed = ranked(keyed, ["_u", "doc_id"])
    part = F.when(F.col("rank") <= F.floor(F.lit(placed.count()) * share), "training").otherwise("test")
    return docs.join(placed.select("doc_id", part.alias("part")), "doc_id")


def sources_of(suspects: DataFrame, spans: DataFrame) -> DataFrame:
    """(source_id): the distinct sources that the suspects' spans name."""
    return spans.join(suspects.select("doc_id").distinct(), "doc_id", "left_semi").select("source_id").distinct()


def split_with_sources(suspects: DataFrame, spans: DataFrame, share: float = 0.7, seed: int = 1) -> DataFrame:
    """(part, role, id): suspects of each side and their sources; a source that training has is not in test."""
    parts = split(suspects, share, seed).select("doc_id", "part")
    sources = spans.select("doc_id", "source_id").join(parts, "doc_id").groupBy("source_id").agg(F.max("part").alias("part"))  # training > test
    return parts.select("part", F.lit("suspect").alias("role"), F.col("doc_id").alias("id")).unionByName(sources.select("part", F.lit("source").alias("role"), F.col("source_id").alias("id")))


def crisp(suspects: DataFrame, spans: DataFrame, paragraphs: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id): suspects with plagiarism, of ``most`` paragraphs at most, all of whose sources have no more.

    ``paragraphs(id, n)`` counts for suspects and sources; a source without a count doesn't qualify.
    """
    small = paragraphs.where(F.col("n") <= most).select("id")
    ok = spans.select("doc_id", "source_id").distinct().join(small.select(F.col("id").alias("source_id"), F.lit(1).alias("_ok")), "source_id", "left")
    whole = ok.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("_ok").alias("k")).where("n = k")
    return suspects.select("doc_id").join(small, suspects.doc_id == small.id, "left_semi").join(whole, "doc_id", "left_semi")


def variable_corpus(suspects: DataFrame, spans: DataFrame) -> DataFrame:
    """(rank, doc_id, source_cutoff): in order of doc_id, how many sources the first ``rank`` suspects need, numbered by first use."""
    placed = ranked(suspects.select("doc_id").distinct(), ["doc_id"])
    first = spans.select("doc_id", "source_id").join(placed, "doc_id").groupBy("source_id").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count("*").alias("new"))
    whole = ranked(placed.join(new, "rank", "left").select("doc_id", "new"), ["doc_id"], "new")
    return whole.select(F.col("rank").cast("int").alias("rank"), "doc_id", F.col("run").alias("source_cutoff"))


def test_corpus(suspects: DataFrame, spans: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id): suspects outside ``training(doc_id)`` that share no source with it."""
    used = sources_of(training, spans)
    tainted = spans.join(used, "source_id", "left_semi").select("doc_id").distinct()
    return suspects.select("doc_id").join(training.select("doc_id"), "doc_id", "left_anti").join(tainted, "doc_id", "left_anti")


def prefix_corpus(suspects: DataFrame, spans: DataFrame, n: int = 250) -> DataFrame:
    """(role, id): the first ``n`` suspects by doc_id, and their sources."""
    chosen = suspects.select("doc_id").orderBy("doc_id").limit(n)
    return chosen.select(F.lit("suspect").alias("role"), F.col("doc_id").alias("id")).unionByName(sources_of(chosen, spans).select(F.lit("source").alias("role"), F.col("source_id").alias("id")))


def sample(suspects: DataFrame, spans: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(role, id): ``n`` suspects drawn by seed, and their sources."""
    chosen = suspects.select("doc_id").orderBy(draw(seed, "doc_id"), "doc_id").limit(n)
    return chosen.select(F.lit("suspect").alias("role"), F.col("doc_id").alias("id")).unionByName(sources_of(chosen, spans).select(F.lit("source").alias("role"), F.col("source_id").alias("id")))


def training_files(docs: DataFrame, spans: DataFrame, n: int, offset: int = 0, least_chars: int = 0, plag_share: float | None = None) -> DataFrame:
    """(doc_id, has_plag): ``n`` documents of ``least_chars`` or more from ``offset`` on, in order of doc_id.

    With ``plag_share`` that part of them (rounded down) have plagiarism, and come first.
    """
    has = spans.select("doc_id").distinct().withColumn("has_plag", F.lit(True))
    d = docs.where(F.length("text") >= least_chars).select("doc_id").join(has, "doc_id", "left").withColumn("has_plag", F.coalesce("has_plag", F.lit(False)))
    if plag_share is None:
        return d.orderBy("doc_id").offset(offset).limit(n)
    with_plag = int(n * plag_share)
    some = lambda plag, k: d.where(F.col("has_plag") == plag).orderBy("doc_id").offset(offset).limit(k)
    return some(True, with_plag).unionByName(some(False, n - with_plag))


def tag_trigram_documents(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id, n): each tag triple with each document that holds it, and how often."""
    from stemmata.operators.features import tag_trigram_documents as count

    return count(docs)


def tag_trigrams(docs: DataFrame, least: int = 1) -> DataFrame:
    """(trigram, n, docs): tag triples by frequency, each with the number of documents that hold it; those seen ``least`` times or more."""
    per = tag_trigram_documents(docs)
    return per.groupBy("trigram").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= least)


def ith_most_common(counts: DataFrame, i: int) -> DataFrame:
    """The row of rank ``i`` (from 1) by ``n``; of equals the trigram that sorts first."""
    return counts.orderBy(F.desc("n"), "trigram").offset(i - 1).limit(1).withColumn("rank", F.lit(i))


def gaussian_clouds(spark: SparkSession, plain: int, plagiarised: int, difference: float, deviation: float = 1.0, dimensions: int = 1, documents: int = 1, seed: int = 1) -> DataFrame:
    """(doc_id, atom_num, feature, value, actual): made-up passages whose plagiarised ones lie ``difference`` off in every dimension.

    Normal numbers come from pairs of ``draw`` (Box and Muller), so each depends on its own key alone.
    """
    rows = spark.range(documents).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(plain + plagiarised - 1))).alias("atom_num"))
    rows = rows.select("*", F.explode(F.array(*(F.lit(f"d{k}") for k in range(dimensions)))).alias("feature"), (F.col("atom_num") >= plain).cast("int").alias("actual"))
    u, v = draw(seed, "doc_id", "atom_num", "feature"), draw(seed + 7919, "doc_id", "atom_num", "feature")
    normal = F.sqrt(-2 * F.log((u * (1 << 32) + 1) / float(1 << 32))) * F.cos(2 * math.pi * v)
    return rows.select("doc_id", "atom_num", "feature", (normal * deviation + F.col("actual") * difference).alias("value"), "actual")
