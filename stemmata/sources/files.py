"""Reading documents, annotations, listings and weights; writing passages, curves and reports. All by Spark's own sources."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str], strip_bom: bool = True) -> DataFrame:
    """(path, name, is_source, text): whole files. ``is_source`` is whether the path says so, ``name`` has no folders and no ending."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if strip_bom:
        d = d.withColumn("text", F.regexp_replace("text", "^\ufeff", ""))
    return d.select("path", short_name(F.col("path")).alias("name"), F.contains("path", F.lit("source")).alias("is_source"), "text")


def short_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


_FEATURE = "_name string, _this_offset bigint, _this_length bigint, _source_reference string, _source_offset bigint, _source_length bigint, _obfuscation string, _translation string"


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(document, start, end, source, source_start, source_end, obfuscation) of the plagiarism that XML annotations mark.

    ``document`` is the file's short name. Annotations of an intrinsic corpus have no source: nulls.
    """
    x = spark.read.format("xml").option("rowTag", "feature").schema(_FEATURE).load(path).select("*", F.col("_metadata.file_path").alias("_path"))
    x = x.where("_name IN ('artificial-plagiarism', 'plagiarism') AND _this_offset IS NOT NULL")
    return x.select(
        short_name(F.col("_path")).alias("document"), F.col("_this_offset").alias("start"), (F.col("_this_offset") + F.col("_this_length")).alias("end"), short_name(F.col("_source_reference")).alias("source"),
        F.col("_source_offset").alias("source_start"), (F.col("_source_offset") + F.col("_source_length")).alias("source_end"), F.col("_obfuscation").alias("obfuscation"),
    )


def read_listing(spark: SparkSession, path: str, folder: str, ending: str = ".txt") -> DataFrame:
    """(path) for each line of a listing of relative names, with or without their ending."""
    line = F.trim("value")
    whole = F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(line, "^/+", ""))
    return spark.read.text(path).where(line != "").select(F.when(whole.endswith(ending), whole).otherwise(F.concat(whole, F.lit(ending))).alias("path"))


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """``names(name)`` with the path of the file of that short name; null where there is none."""
    return names.join(files.select(short_name(F.col("path")).alias("name"), "path"), "name", "left")


def write_passages(features: DataFrame, scores: DataFrame, truths: DataFrame, path: str) -> None:
    """CSV with header: doc_id, start_index, end_index, the features, plag_confidence, contains_plag."""
    names = [c for c in features.columns if c not in ("doc_id", "atom_num")]
    j = features.join(truths.select("doc_id", "atom_num", "start", "end", "truth"), ["doc_id", "atom_num"]).join(scores, ["doc_id", "atom_num"], "left")
    j.select("doc_id", F.col("start").alias("start_index"), F.col("end").alias("end_index"), *(F.col(f"`{c}`") for c in names), F.col("confidence").alias("plag_confidence"), F.col("truth").alias("contains_plag")).write.mode("overwrite").csv(path, header=True)


def write_lengths(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", F.length("text").alias("length")).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("ignoreLeadingWhiteSpace", True)
    return r.csv(path, header=True, schema=schema) if schema else r.csv(path, header=True, inferSchema=True)


def write_curve(points: DataFrame, path: str, **about: object) -> None:
    """Points of a curve as JSON lines, with what they are about beside each."""
    points.withColumn("about", F.lit(json.dumps(about, sort_keys=True))).write.mode("overwrite").json(path)


def write_weights(spark: SparkSession, path: str, kind: str, features: list[str], weights: list[float]) -> None:
    """Append a weighting scheme (kind, features, weights)."""
    spark.createDataFrame([(kind, features, [float(w) for w in weights])], "kind string, features array<string>, weights array<double>").write.mode("append").json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, features array<string>, weights array<double>").json(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Trial results with the time they were added."""
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def oldest_trial(trials: DataFrame, key: list[str]) -> DataFrame:
    """The first trial of each setting by its timestamp."""
    w = Window.partitionBy(*key).orderBy("timestamp")
    return trials.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trial_grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the named values: one row for each trial to run."""
    grid = None
    for name, vs in values.items():
        one = spark.createDataFrame([(v,) for v in vs], [name])
        grid = one if grid is None else grid.crossJoin(one)
    if grid is None:
        raise ValueError("no values")
    return grid


TRIAL = "corpus string, features array<string>, atom_type string, cluster_type string, k int, first_doc int, n int, min_len int, cheating boolean, documents bigint, roc_path string, auc double"


def append_trial(spark: SparkSession, path: str, **figures: object) -> None:
    """One run's settings and figures as a row of ``TRIAL``, with the time it was added; what isn't given is null."""
    names = [x.split()[0] for x in TRIAL.split(", ")]
    if unknown := set(figures) - set(names):
        raise ValueError(f"no column of a trial: {', '.join(sorted(unknown))}")
    append_results(spark.createDataFrame([tuple(figures.get(n) for n in names)], TRIAL), path)


def feature_sets(features: list[str], sizes: list[int]) -> list[list[str]]:
    """Every choice of each of the given sizes, for ``trial_grid``."""
    return [list(c) for k in sizes for c in combinations(features, k)]


def upsert(new: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    """``there`` and the rows of ``new`` whose key it lacks; of repeated new keys the least row in order of the columns."""
    rest = [c for c in there.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest)) if rest else new.select(*key).distinct()
    return there.unionByName(once.join(there.select(*key), key, "left_anti").select(*there.columns))


def passage_json(rows: DataFrame) -> DataFrame:
    """(doc_id, json): each row as a JSON object."""
    return rows.select("doc_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def passage_html(atoms: DataFrame, truths: DataFrame, scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, html): the document's passages in order, those above the cut marked, the true ones underlined."""
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    j = atoms.join(truths.select("doc_id", "atom_num", "truth"), ["doc_id", "atom_num"], "left").join(scores, ["doc_id", "atom_num"], "left")
    body = F.when(F.col("truth") == 1, F.concat(F.lit("<u>"), esc, F.lit("</u>"))).otherwise(esc)
    part = F.when(F.col("confidence") > cut, F.concat(F.lit("<mark>"), body, F.lit("</mark>"))).otherwise(body)
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom_num", part.alias("p")))), lambda x: x["p"]), "").alias("html"))


def report(scores: DataFrame, atoms: DataFrame, cut: float = 0.5) -> DataFrame:
    """(doc_id, side, n, passages): the texts at or below the cut, and those above it."""
    j = scores.join(atoms.select("doc_id", "atom_num", "text"), ["doc_id", "atom_num"])
    side = F.when(F.col("confidence") > cut, "above").otherwise("below")
    return j.groupBy("doc_id", side.alias("side")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("atom_num", "text"))), lambda x: x["text"]).alias("passages"))
