"""Interval operators on (start, end) pairs: start inclusive, end exclusive; an empty span overlaps nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """How many places two spans share; 0 with a null. (``least`` and ``greatest`` skip nulls.)"""
    there = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    return F.when(there, F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))).otherwise(0)


def attach(atoms: DataFrame, spans: DataFrame) -> DataFrame:
    """Atoms with the parts of ``spans(doc_id, start, end, source_id)`` inside each: ``plag_spans``, relative to the atom and in order.

    An equi-join on doc_id with the overlap as condition; atoms without any keep an empty array.
    """
    s = spans.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "source_id")
    j = atoms.select("doc_id", "atom_num", "start", "end").join(s, "doc_id").where("_s < end AND _e > start AND _s < _e AND start < end")
    part = F.struct((F.greatest("_s", "start") - F.col("start")).alias("start"), (F.least("_e", "end") - F.col("start")).alias("end"), "source_id")
    found = j.groupBy("doc_id", "atom_num").agg(F.array_sort(F.collect_list(part)).alias("plag_spans"))
    out = atoms.join(found, ["doc_id", "atom_num"], "left")
    return out.withColumn("plag_spans", F.coalesce("plag_spans", F.array().cast(found.schema["plag_spans"].dataType)))


def truth(atoms: DataFrame, spans: DataFrame, cheating: bool = False, min_chars: int = 0) -> DataFrame:
    """(doc_id, atom_num, start, end, truth, n_plag): whether each atom is plagiarised.

    Any overlap counts. With ``cheating`` one span must cover over half of it, and atoms are left out that are
    shorter than ``min_chars`` or whose total overlap is above nothing but below half.
    """
    s = spans.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    j = atoms.select("doc_id", "atom_num", "start", "end").join(s, "doc_id", "left")
    o = overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))
    g = j.groupBy("doc_id", "atom_num", "start", "end").agg(F.max(o).alias("_most"), F.sum(o).alias("n_plag"))
    size = F.col("end") - F.col("start")
    if cheating:
        g = g.where((size >= min_chars) & ~((F.col("n_plag") > 0) & (F.col("n_plag") < size / 2)))
        hit = F.col("_most") > size / 2
    else:
        hit = F.col("_most") > 0
    return g.select("doc_id", "atom_num", "start", "end", hit.cast("int").alias("truth"), "n_plag")


def underline(text: Column, spans: Column, mark: str = "_") -> Column:
    """The text with marks around each of the sorted ``spans``; where they overlap the shared part is written twice."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.lit(mark), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(mark)).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return done
