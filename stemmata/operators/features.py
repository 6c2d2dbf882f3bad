"""Stylometric features of passages: a registry of names, a parser for ``avg(...)`` and ``std(...)``, and one plan for all of them.

A passage touches units: words, sentences, paragraphs. A feature is defined over one level of units; the passage
first grows to all units of that level that it touches. A text is cut once, in the task that reads it, whatever is asked
of it, and gives one row a passage (``functions.style``); nothing is shuffled but the external word frequencies where
their table is too large to be sent to every worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemmata.functions import lexicon as lx
from stemmata.functions import style
from stemmata.functions import tokenize as tk
from stemmata.operators.atoms import documents
from stemmata.session import BROADCAST_BYTES, Scratch, small

KEY = ["doc_id", "atom_num"]
HUGE = 1e255
CHUNK = 1 << 20
LEVELS = ["char", "word", "sentence", "paragraph"]
WORD = [
    "num_chars", "average_word_length", "average_syllables_per_word", "stopword_percentage", "syntactic_complexity", "avg_internal_word_freq_class", "avg_external_word_freq_class",
    *(f"word_unigram,{w}" for w in lx.UNIGRAMS), *(f"pos_trigram,{t}" for t in lx.POS_TRIGRAMS),
]
CHAR = ["punctuation_percentage", *(f"vowelness_trigram,{t}" for t in lx.VOWEL_TRIGRAMS)]
SENTENCE = ["average_sentence_length", "gunning_fog_index", "honore_r_measure", "yule_k_characteristic", "syntactic_complexity_average"]
EVOLVED = [f"evolved_feature_{k}" for k in ("two", "three", "four", "five", "six")]
PARAGRAPH = ["flesch_reading_ease", "flesch_kincaid_grade", *EVOLVED]
NESTABLE = {"word": ["num_chars", "average_syllables_per_word", "stopword_percentage", "syntactic_complexity", "avg_internal_word_freq_class", "avg_external_word_freq_class"], "sentence": ["average_sentence_length", "syntactic_complexity_average"]}
_TRAINING = [x for x in [*WORD, *CHAR, *SENTENCE, *PARAGRAPH] if not x.startswith(("pos_", "evolved", "average_word")) and x not in ("syntactic_complexity_average", "vowelness_trigram,V,V,C", "vowelness_trigram,V,V,V")]
#: Named choices of features: those of a published study of style, those computed for training, and those with nested ones for testing.
SUBSETS: dict[str, list[str]] = {
    "study": [x for x in [*WORD, *SENTENCE, *PARAGRAPH] if x.startswith(("average_word", "average_syll", "avg_external", "gunning", "honore", "yule", "flesch_kincaid"))],
    "training": _TRAINING,
    "test": [
        *_TRAINING,
        *(f"{a}({b})" for b in NESTABLE["word"] if b != "syntactic_complexity" for a in ("avg", "std") if (a, b) != ("std", "stopword_percentage")),
        "avg(std(average_syllables_per_word))",
    ],
}


def catalogue() -> list[str]:
    """All names, the nested ones too."""
    nested = [f"{a}({b})" for b in NESTABLE["word"] for a in ("avg", "std")] + [f"avg({a}({b}))" for b in NESTABLE["word"] for a in ("avg", "std")]
    nested += [f"{a}({b})" for b in NESTABLE["sentence"] for a in ("avg", "std")]
    return [*WORD, *CHAR, *SENTENCE, *PARAGRAPH, *nested]


def parse(name: str) -> list[str]:
    """``avg(std(num_chars))`` to [avg, std, num_chars]."""
    parts = name.rstrip(")").split("(")
    if name.count("(") != name.count(")") or len(parts) - 1 != name.count(")") or any(p not in ("avg", "std") for p in parts[:-1]):
        raise ValueError(f"not a feature: {name!r}")
    return parts


def level(base: str) -> str:
    for where, names in (("word", WORD), ("char", CHAR), ("sentence", SENTENCE), ("paragraph", PARAGRAPH)):
        if base in names:
            return where
    raise ValueError(f"no feature {base!r}; one of {', '.join(catalogue())}")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            count.update(tk.tokens(text)[0])
        total: Counter[str] = Counter()
        for token, n in count.items():
            total[lx.Lexicon.norm(token)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): the background table, counted over all documents, each batch in the task that reads it."""
    return documents(docs).select("text").mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _classes(top: int, numbers: np.ndarray) -> np.ndarray:
    return np.floor(np.log2((top + 1) / (numbers.astype(np.float64) + 1))).astype(np.int64)


class _Background(NamedTuple):
    """External classes: ``floor(log2((highest + 1) / (own + 1)))``, of a word's normal form; ``table`` is None where each text brings its own.

    The table is the numbers by word, or sorted digests of words and their classes, beside the class of all others.
    """

    table: Broadcast | None
    top: int
    rest: int | None = None

    def classes(self, words: list[str], own: dict[str, int]) -> np.ndarray:
        if self.rest is None:
            held = own if self.table is None else self.table.value
            return _classes(self.top, np.array([held.get(w, 0) for w in words]))
        digests, classes = self.table.value  # type: ignore[union-attr]
        if not len(digests):
            return np.full(len(words), self.rest, np.int64)
        asked = np.array([_digest(w) for w in words], np.int64)
        at = np.minimum(np.searchsorted(digests, asked), len(digests) - 1)
        return np.where(digests[at] == asked, classes[at].astype(np.int64), self.rest)


@lru_cache(1 << 17)
def _digest(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_digest(w) for w in batch.column(0).to_pylist()], pa.int64()), batch.column(1)], ["digest", "n"])


def _with_background(docs: DataFrame, frequencies: DataFrame | None) -> tuple[DataFrame, _Background]:
    """A small table goes to every worker; else each document gets the numbers of its own words by a join on the word.

    A table that was counted over ``docs`` has all of its words, so it may go as digests (9 bytes a word, 8 times what is small) without the words of
    the class of those that occur once, which are about half; but not if any two words of it share a digest.
    """
    spark, counted = docs.sparkSession, frequencies is None
    if frequencies is None:
        frequencies = Scratch(spark, "frequencies").keep(word_frequencies(docs), "table")
    f = frequencies.select("word", F.col("n").cast("bigint").alias("n")).where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    size = f.agg(F.count("*"), F.max("n")).first()
    rows, top = size[0], size[1] or 0
    if rows * 128 <= BROADCAST_BYTES:
        return docs, _Background(spark.sparkContext.broadcast({r["word"]: r["n"] for r in f.collect()}), top)
    rest = int(_classes(top, np.ones(1))[0])
    least = next(n for n in (2, 3, 4) if _classes(top, np.array([n]))[0] != rest)
    if counted and frequencies.where(F.col("n") >= least).count() * 9 <= 8 * BROADCAST_BYTES:
        made = Scratch(spark, "digests").keep(frequencies.mapInArrow(_digests, "digest bigint, n bigint"), "table")
        if made.select("digest").distinct().count() == rows:
            t = made.where(F.col("n") >= least).toPandas().sort_values("digest")
            return docs, _Background(spark.sparkContext.broadcast((t["digest"].to_numpy(np.int64), _classes(top, t["n"].to_numpy()).astype(np.int8))), top, rest)
    words = docs.mapInArrow(_vocabulary, "doc_id bigint, word string").distinct()  # rows that repeat a doc_id share one list
    lists = words.join(small(f, rows, 64), "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "n")).alias("_w"))  # a document's different words
    return docs.join(lists, "doc_id", "left").select("doc_id", "text", F.col("_w.word").alias("_words"), F.col("_w.n").alias("_n")), _Background(None, top)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [sorted({lx.Lexicon.norm(t) for t in set(tk.tokens(text)[0])}) for text in batch.column(1).to_pylist()]
        ids = np.repeat(np.asarray(batch.column(0), np.int64), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([w for x in own for w in x], pa.string())], ["doc_id", "word"])


def _needed(names: list[str]) -> list[str]:
    """The columns that the named features are made of: themselves, or an evolved formula's parts."""
    out = [x for x in names if x not in EVOLVED]
    if any(x in EVOLVED for x in names):
        out += [f"sum of {x}" for x in [*_PARTS, "honore_r_measure", "flesch_reading_ease", "flesch_kincaid_grade"]]
    return out


def _values(chunk: style.Chunk, columns: list[str]) -> list[np.ndarray]:
    where = {x: level(parse(x)[-1]) for x in columns if not x.startswith("sum of ")}
    has = lambda k: any(w == k and "(" not in x for x, w in where.items())
    chars, sentences = chunk.char_level() if has("char") else {}, chunk.sentence_level() if has("sentence") else {}
    paragraphs = chunk.paragraph_level(_PARTS if len(where) < len(columns) else []) if has("paragraph") or len(where) < len(columns) else {}
    out = []
    for x in columns:
        if x.startswith("sum of "):
            out.append(paragraphs[x[7:]])
        elif "(" in x:
            *wrappers, base = parse(x)
            out.append(chunk.nested(wrappers, base, where[x] == "sentence"))
        else:
            out.append({"word": lambda: chunk.own().value(x), "char": lambda: chars[x], "sentence": lambda: sentences[x], "paragraph": lambda: paragraphs[f"first {x}"]}[where[x]]())
    return out


def _features(batches: Iterator[pa.RecordBatch], columns: list[str], kind: str, n: int, lexicon: lx.Lexicon, background: _Background | None) -> Iterator[pa.RecordBatch]:
    words = style.words_of(lexicon)
    def emit(ids: list[int], texts: list[str], lists: list) -> pa.RecordBatch:
        def external(d: int, different: list[str]) -> np.ndarray:
            own = dict(zip(lists[0][d] or [], lists[1][d] or [])) if lists else {}
            return background.classes(different, own)  # type: ignore[union-attr]

        chunk = style.Chunk(texts, kind, n, words, external if background is not None else None)
        values = _values(chunk, columns)
        some = ~np.all([np.isnan(v) for v in values], axis=0)
        cols = [pa.array(np.array(ids, np.int64)[chunk.atom_doc][some]), pa.array(chunk.atom_num[some].astype(np.int32))]
        cols += [pa.array(v[some], pa.float64(), mask=np.isnan(v[some])) for v in values]
        return pa.RecordBatch.from_arrays(cols, [*KEY, *columns])

    for batch in batches:
        at, size = 0, 0
        for k, length in enumerate(pc.utf8_length(batch.column(1)).to_pylist(), 1):
            size += length
            if size > CHUNK or k == batch.num_rows:
                part = batch.slice(at, k - at)
                yield emit(part.column(0).to_pylist(), part.column(1).to_pylist(), [c.to_pylist() for c in part.columns[2:]])
                at, size = k, 0


def features(docs: DataFrame, names: list[str], atom: str = "nchars", n: int = 500, frequencies: DataFrame | None = None, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """(doc_id, atom_num, a column for each of ``names``) of each passage of ``docs(doc_id, text)``, from one pass over the texts.

    ``names`` are those of ``catalogue``, plain and nested. ``frequencies(word, n)`` is the background of the external classes, counted over
    ``docs`` if not given; ``lexicon`` replaces the stand-in resources. A feature is null where the passage touches no unit of its
    level, and a passage whose features all are is left out. Null ids and texts are left out, an empty text is a passage without words; rows that
    repeat a doc_id are each cut by themselves and give rows of their own; texts of any length are cut whole; an empty table gives an
    empty result; other columns are ignored.
    """
    if not names:
        raise ValueError("no names")
    for name in names:
        *wrappers, base = parse(name)
        where = level(base)
        if wrappers and base not in NESTABLE.get(where, []):
            raise ValueError(f"{base!r} can't be nested")
        if wrappers and (LEVELS.index(where) + len(wrappers) >= len(LEVELS) or "std" in wrappers[:-1]):
            raise ValueError(f"{name!r} goes beyond the paragraph, or takes std of a nested value")
    tk.tokenize("", atom, n)
    d, background = documents(docs), None
    if any("avg_external" in x for x in names):
        d, background = _with_background(d, frequencies)
    columns = _needed(names)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("atom_num", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    out = d.mapInArrow(partial(_features, columns=columns, kind=atom, n=n, lexicon=lexicon or lx.Lexicon(), background=background), schema)
    made = {k: F.when(F.col("`sum of num_chars`").isNotNull(), v) for k, v in evolved(lambda x: F.col(f"`sum of {x}`")).items()} if set(names) & set(EVOLVED) else {}
    return out.select(*KEY, *(made[x].alias(x) if x in made else F.col(f"`{x}`") for x in names))


def word_features(docs: DataFrame, names: list[str], atom: str = "nchars", n: int = 500, frequencies: DataFrame | None = None, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """``features`` of the word level: one row for each passage that touches a word."""
    for x in names:
        if level(x) != "word":
            raise ValueError(f"{x!r} is no word feature")
    return features(docs, names, atom, n, frequencies, lexicon)


def char_features(docs: DataFrame, atom: str = "nchars", n: int = 500) -> DataFrame:
    """Share of punctuation, and counts of vowel and consonant triples (V is aeiou, C any other ASCII letter), of each passage."""
    return features(docs, CHAR, atom, n)


def sentence_features(docs: DataFrame, atom: str = "nchars", n: int = 500, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """Features over whole sentences: length, fog, Honore's R (100 ln(N) / (1 - V1 / V), V one more than the stems), Yule's K, mean complexity."""
    return features(docs, SENTENCE, atom, n, lexicon=lexicon)


def paragraph_features(docs: DataFrame, atom: str = "paragraph", n: int = 500, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """Readability of the first paragraph with words that each passage touches, and the evolved formulas over all of them."""
    return features(docs, PARAGRAPH, atom, n, lexicon=lexicon)


def nested_features(docs: DataFrame, names: list[str], atom: str = "nchars", n: int = 500, frequencies: DataFrame | None = None, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """Values of ``avg(...)`` and ``std(...)`` names: one column each.

    Each wrapper raises the level by one. ``avg`` is the inner value over the whole range divided by the number of its
    units; ``std`` the population deviation of the units' values, one level deep.
    """
    return features(docs, names, atom, n, frequencies, lexicon)


def _tag_trigrams(batches: Iterator[pa.RecordBatch], lexicon: lx.Lexicon) -> Iterator[pa.RecordBatch]:
    words = style.words_of(lexicon)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size <= CHUNK:
                size += len(texts[end])
                end += 1
            chunk = style.Chunk(texts[at:end], "sentence", 0, words)
            lo, hi = chunk.touched("sentence", "word")
            _, i = style.expand(lo, np.maximum(hi - 2, lo))
            # tags are numbered anew for each chunk: their numbers among all normal forms would overflow in the third power
            used, tag = np.unique(chunk.column("tag"), return_inverse=True)
            m = len(used)
            (kinds, count) = np.unique(((chunk.doc[i] * m + tag[i]) * m + tag[i + 1]) * m + tag[i + 2], return_counts=True) if len(i) else (i, i)
            keys = {k: x[4:] for x, k in words.keys.items() if x.startswith("tag ")}
            names = [keys[k] for k in used.tolist()]
            trigrams = [",".join(names[int(k) // m**p % m] for p in (2, 1, 0)) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(trigrams, pa.string()), pa.array([ids[at + int(k) // m**3] for k in kinds], pa.int64()), pa.array(count, pa.int64())], ["trigram", "doc_id", "n"])
            at = end


def tag_trigram_documents(docs: DataFrame, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """(trigram, doc_id, n): each triple of tags within a sentence with each document that holds it, and how often; counted in the task that reads it."""
    per = documents(docs).mapInArrow(partial(_tag_trigrams, lexicon=lexicon or lx.Lexicon()), "trigram string, doc_id bigint, n bigint")
    return per.groupBy("trigram", "doc_id").agg(F.sum("n").alias("n"))


def _guard(value: Column) -> Column:
    """Overflow and undefined results become the largest score."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), HUGE).otherwise(value)


def evolved(c: Callable[[str], Column]) -> dict[str, Column]:
    """The five evolved formulas over a paragraph range's sums; ``c`` gives a feature's column."""
    two = _guard((1.5 * c("avg_internal_word_freq_class") - c("pos_trigram,NN,IN,DT") + 12.0**10 + c("syntactic_complexity") + 30.0) * (10.0 * (F.pow(1.5 + c("pos_trigram,NN,NN,VB"), -12.0 - c("honore_r_measure")) + 12.0 * c("pos_trigram,NN,NN,NN") + 1.0)))
    b, j = c("average_syllables_per_word"), c("honore_r_measure")
    power = F.pow(1.5 - j, F.when((j > 1.5) & (b != F.floor(b)), F.floor(b)).otherwise(b))
    return {
        "evolved_feature_two": two,
        "evolved_feature_three": two - 2 * c("num_chars") - c("stopword_percentage") + c("syntactic_complexity"),
        "evolved_feature_four": two + c("flesch_kincaid_grade") + 6 * c("flesch_reading_ease") + c("stopword_percentage") - c("pos_trigram,DT,NNS,IN"),
        "evolved_feature_five": _guard(5 * F.pow(F.lit(4.0), power - b - j - 3)),
        "evolved_feature_six": _guard(20 * c("word_unigram,been") * c("flesch_reading_ease") * F.pow(F.lit(6.5), F.pow(c("pos_trigram,VB,NN,VB"), c("pos_trigram,DT,NN,IN"))) + two),
    }


_PARTS = ["avg_internal_word_freq_class", "syntactic_complexity", "pos_trigram,NN,NN,VB", "pos_trigram,NN,NN,NN", "pos_trigram,NN,IN,DT", "num_chars", "stopword_percentage", "average_syllables_per_word", "pos_trigram,DT,NNS,IN", "pos_trigram,VB,NN,VB", "pos_trigram,DT,NN,IN", "word_unigram,been"]


def vectors(features: DataFrame, names: list[str], weights: list[float] | None = None) -> DataFrame:
    """(doc_id, atom_num, feature, value): the long form that scoring takes, each value times its weight if given."""
    w = weights or [1.0] * len(names)
    pairs = F.array(*(F.struct(F.lit(x).alias("feature"), (F.col(f"`{x}`") * F.lit(float(k))).alias("value")) for x, k in zip(names, w)))
    return features.select(*KEY, F.explode(pairs).alias("p")).select(*KEY, "p.feature", "p.value")
