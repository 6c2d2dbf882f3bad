"""The registered queries: each takes (spark, folder of tables) and runs one operator over the whole of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions import fingerprint as fp
from stemmata.functions import lexicon as lx
from stemmata.operators import combine as cb
from stemmata.operators import corpus as cp
from stemmata.operators import evaluate as ev
from stemmata.operators import features as ft
from stemmata.operators import fingerprints as fpr
from stemmata.operators import models as ml
from stemmata.operators import scoring as sc
from stemmata.operators import search as se
from stemmata.operators import spans as sp
from stemmata.operators.atoms import atoms, documents, nchars_spans
from stemmata.plans import sql
from stemmata.session import Scratch, prepare
from stemmata.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
N, K, T = 500, 8, 13
WIDE = {"span": fp.WIDE}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"))


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with each line feed doubled, so that lines are paragraphs."""
    return docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places or so, and no negative zeros."""
    short = lambda c: F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits))
    return df.select(*(short(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


for _kind, _sql, _source in (("word", sql.tokens(), "words"), ("sentence", sql.SENTENCES, "sentences"), ("paragraph", sql.PARAGRAPHS, "paragraphs"), ("line", sql.LINES, "lines")):

    def _atoms(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return atoms((spaced if kind == "paragraph" else docs)(spark, sf_dir), kind)

    QUERIES[f"atoms_{_kind}"] = _atoms
    SQL[f"atoms_{_kind}"] = sql.atoms_of(_sql, _source, sql.SPACED if _kind == "paragraph" else sql.TEXTS)


@query(f'WITH {sql.TEXTS}, {sql.nchars(N)} SELECT doc_id, atom_num, s AS start, e AS "end", text FROM atoms')
def atoms_nchars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(docs(spark, sf_dir), "nchars", N)


@query(f'WITH {sql.TEXTS} SELECT doc_id, 0 AS atom_num, 0 AS start, CAST(length(text) AS INTEGER) AS "end", text FROM texts')
def atoms_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(docs(spark, sf_dir), "full")


PLAIN = ["num_chars", "average_word_length", "average_syllables_per_word", "stopword_percentage", "syntactic_complexity", "avg_internal_word_freq_class", *(f"word_unigram,{u}" for u in lx.UNIGRAMS)]


@query(sql.WORD_FEATURES)
def features_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.word_features(docs(spark, sf_dir), PLAIN, n=N))


@query(sql.WORD_FREQUENCIES)
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.word_frequencies(docs(spark, sf_dir))


@query(sql.EXTERNAL)
def features_external_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.word_features(docs(spark, sf_dir), ["avg_external_word_freq_class"], n=N))


@query(sql.TRIGRAMS)
def features_pos_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.word_features(docs(spark, sf_dir), [f"pos_trigram,{t}" for t in lx.POS_TRIGRAMS], n=N)


@query(sql.CHAR_FEATURES)
def features_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.char_features(docs(spark, sf_dir), n=N))


@query(sql.SENTENCE_FEATURES)
def features_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.sentence_features(docs(spark, sf_dir), n=N))


@query(sql.PARAGRAPH_FEATURES)
def features_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evolved formulas reach 1e13 and 1e255: the logarithm of their size is compared."""
    f = ft.paragraph_features(spaced(spark, sf_dir))
    logs = [(F.signum(f"evolved_feature_{k}") * F.log10(1 + F.abs(f"evolved_feature_{k}"))).alias(f"log_evolved_{k}") for k in ("two", "three", "four", "five", "six")]
    return rounded(f.select("doc_id", "atom_num", "flesch_reading_ease", "flesch_kincaid_grade", *logs))


@query(sql.NESTED)
def features_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.nested_features(docs(spark, sf_dir), ["avg(num_chars)", "std(num_chars)", "std(stopword_percentage)", "avg(stopword_percentage)"], n=N))


@query(sql.NESTED_SENTENCES)
def features_nested_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names with one wrapper around a word feature."""
    return rounded(ft.nested_features(docs(spark, sf_dir), [f"{a}({b})" for b in ft.NESTABLE["word"] for a in ("avg", "std")], n=N))


@query(sql.NESTED_PARAGRAPHS)
def features_nested_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names that reach the paragraph."""
    names = [f"avg({a}({b}))" for b in ft.NESTABLE["word"] for a in ("avg", "std")] + [f"{a}({b})" for b in ft.NESTABLE["sentence"] for a in ("avg", "std")]
    return rounded(ft.nested_features(spaced(spark, sf_dir), names, n=N), 9)


@query()
def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue in one pass."""
    return rounded(ft.features(docs(spark, sf_dir), ft.catalogue(), n=N))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.vectors(ft.word_features(docs(spark, sf_dir), sql.FEATURES5, n=N), sql.FEATURES5)


@query(sql.OUTLIER)
def score_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.outlier(_long(spark, sf_dir)))


@query(sql.WEIGHTED)
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.outlier(ft.vectors(ft.word_features(docs(spark, sf_dir), sql.FEATURES5, n=N), sql.FEATURES5, [2.0, 1.0, 1.0, 3.0, 1.0])))


@query(sql.MEDIAN)
def score_median_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.median_simple(_long(spark, sf_dir)))


@query(sql.RESCALED)
def score_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.rescale(sc.outlier(_long(spark, sf_dir))))


@query(sql.DISTRIBUTION)
def feature_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.distribution(_long(spark, sf_dir)))


@query(sql.UNMASK)
def score_unmasking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.unmask(_long(spark, sf_dir), sql.FEATURES5))


for _method in ("kmeans", "kmedians", "agglom", "hmm"):

    def _clustered(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return rounded(sc.cluster(_long(spark, sf_dir), method))

    QUERIES[f"score_{_method}"] = _clustered


@query()
def score_median_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.cluster(_long(spark, sf_dir).where("feature = 'average_word_length'"), "median_kmeans"))


@query()
def score_combined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.combine_confidences(_long(spark, sf_dir), [2.0, 1.0, 1.0, 3.0, 1.0]))


@query(sql.WINNOW)
def fingerprints_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.fingerprints(docs(spark, sf_dir), "winnow-k", K, T)


@query(sql.FULL)
def fingerprints_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.gram_counts(docs(spark, sf_dir), "full", 5)


@query(sql.KTH)
def fingerprints_kth_in_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.chosen_grams(docs(spark, sf_dir), "kth_in_sent", 5, 3).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


@query(sql.ANCHORED)
def fingerprints_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.chosen_grams(docs(spark, sf_dir), "anchor", 5).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


@query()
def fingerprints_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.fingerprints(docs(spark, sf_dir), "kth_in_sent", 5, 3)


@query(f"WITH {sql.DIGRAMS} SELECT digram, n FROM dg")
def digram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.digrams(docs(spark, sf_dir))


@query(sql.ANCHOR_SQL)
def anchor_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.anchors(docs(spark, sf_dir))


@query(f"WITH {sql.TEXTS}, {sql.winnowed('texts', 'doc_id', 'd')} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS passages, count(*) AS hashes FROM d")
def index_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.populated(fpr.fingerprints(docs(spark, sf_dir), "winnow-k", K, T))


@query(f"WITH {sql.TEXTS}, {sql.ITEMS}, {sql.winnowed('texts', 'doc_id', 'd')}, {sql.winnowed('items', 'item_id', 'i')} SELECT h AS hash_value, doc_id, 0 AS atom_num FROM d WHERE h IN (SELECT h FROM i)")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.lookup(fpr.fingerprints(docs(spark, sf_dir), "winnow-k", K, T), fpr.fingerprints(items(spark, sf_dir), "winnow-k", K, T))


@query(sql.LOOKUP_DOCS)
def index_lookup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``index_lookup``, of the labelled documents."""
    return se.lookup(fpr.fingerprints(docs(spark, sf_dir), "winnow-k", K, T), fpr.fingerprints(items(spark, sf_dir), "winnow-k", K, T), table(spark, sf_dir, "labels").select("doc_id"))


@query(sql.INDEX)
def sink_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written, written again (which adds nothing), and read."""
    at = f"{Scratch(spark, 'index').base}/index"
    for _ in range(2):
        se.write_index(fpr.fingerprints(docs(spark, sf_dir), "winnow-k", K, T), at, "winnow-k", True)
    return se.read_index(spark, at, "winnow-k", True).select("doc_id", "atom_num", "hash_value", F.col("bucket").cast("int").alias("bucket"))


@query(sql.SINK_PASSAGES)
def sink_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as CSV and read; the score is made up."""
    at = f"{Scratch(spark, 'passages').base}/csv"
    f = rounded(ft.word_features(docs(spark, sf_dir), ["num_chars", "average_word_length"], n=N))
    files.write_passages(f, f.select("doc_id", "atom_num", F.round(F.col("num_chars") / 1000, 6).alias("confidence")), _truth(spark, sf_dir), at)
    return files.read_csv(spark, at, "doc_id bigint, start_index int, end_index int, num_chars double, average_word_length double, plag_confidence double, contains_plag int")


@query(f"WITH {sql.TEXTS} SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM texts")
def sink_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{Scratch(spark, 'lengths').base}/csv"
    files.write_lengths(docs(spark, sf_dir), at)
    return files.read_csv(spark, at, "doc_id bigint, length int")


@query(sql.UPSERTED)
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels, and a row for each document that has none."""
    there = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select("doc_id", "quality")
    return files.upsert(docs(spark, sf_dir).select("doc_id", F.lit(-1).alias("quality")), there, ["doc_id"])


def item_search(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """Of each benchmark item the document that holds most of it."""
    found = se.search_among_texts(_item_prints(spark, sf_dir), docs(spark, sf_dir), se.Method("winnow-k", K, T, span=fp.WIDE), measure)
    return rounded(found.select(F.col("doc_id").alias("item_id"), "source_id", "shared", "confidence"))


for _measure in se.SIMILARITIES:

    def _searched(spark: SparkSession, sf_dir: str, measure: str = _measure) -> DataFrame:
        return item_search(spark, sf_dir, measure)

    QUERIES[f"search_{_measure.replace('-', '_')}"] = _searched
    SQL[f"search_{_measure.replace('-', '_')}"] = sql.itemed(_measure)


ATOM_PRINTS = se.Method("winnow-k", K, T, "nchars", N, fp.WIDE)


def _item_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr.fingerprints(items(spark, sf_dir), "winnow-k", K, T, **WIDE)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(docs(spark, sf_dir)).select("doc_id", F.explode(nchars_spans(F.length("text"), N)).alias("a"))
    return d.select("doc_id", "a.atom_num", "a.start", "a.end")


def _ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_texts(docs(spark, sf_dir), ATOM_PRINTS, _item_prints(spark, sf_dir), "jaccard")


@query(sql.ATOM_SEARCH)
def search_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ext(spark, sf_dir).select("doc_id", "atom_num", "source_id", "shared", "confidence"))


@query(sql.SHORT_SEARCH)
def search_atoms_but_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``search_atoms``; passages under 300 characters are too short to judge."""
    found = se.search_texts(docs(spark, sf_dir), ATOM_PRINTS, _item_prints(spark, sf_dir), "jaccard", least=300)
    return rounded(found.select("doc_id", "atom_num", "source_id", "shared", "confidence"))


@query(sql.TWO_LEVEL)
def search_two_level_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.two_level_texts(docs(spark, sf_dir), ATOM_PRINTS, _item_prints(spark, sf_dir))
    return rounded(found.select("doc_id", "atom_num", "source_id", "shared", "confidence"))


@query(sql.TWO_LEVEL_PASSAGES)
def search_two_level_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(se.two_level_texts(docs(spark, sf_dir), ATOM_PRINTS, _item_prints(spark, sf_dir), passages_first=True))


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written in the shared folder: what is read several times is made once, and outlives any executor."""
    return Scratch(df.sparkSession, what).keep(df, "table")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.occurrences(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(sql.OCCURRENCES)
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.truth(_pieces(spark, sf_dir), _spans(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each atom with its truth and its extrinsic confidence."""
    t = _truth(spark, sf_dir).select("doc_id", "atom_num", "start", "end", F.col("truth").alias("actual"))
    return t.join(_ext(spark, sf_dir).select("doc_id", "atom_num", "confidence"), ["doc_id", "atom_num"])


@query(sql.TRUTH)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir)


def _sources_cols(spans: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(F.lit("none"), F.lit("low"), F.lit("high")), (F.pmod(F.col("doc_id") + F.col("source_id"), F.lit(3)) + 1).cast("int"))
    return spans.withColumns({"source_start": F.lit(0), "source_end": F.col("end") - F.col("start"), "obfuscation": kind})


@query(sql.GROUND_SOURCES)
def ground_truth_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each atom's spans with their sources, written out; atoms with a highly obfuscated one are left out (the degree is made up from the ids)."""
    t = ev.without_high_obfuscation(ev.atom_truth(_pieces(spark, sf_dir), _sources_cols(_spans(spark, sf_dir))))
    one = lambda i, at: F.concat(F.col("spans")[at].start, F.lit("-"), F.col("spans")[at].end, F.lit(":"), F.col("sources")[at], F.lit(":"), F.col("source_spans")[at].source_start, F.lit("-"), F.col("source_spans")[at].source_end, F.lit(":"), i)
    return t.select("doc_id", "atom_num", "truth", F.array_join(F.transform("obfuscation", one), " ").alias("found"))


@query(sql.CHEATING)
def ground_truth_cheating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.truth(_pieces(spark, sf_dir), _spans(spark, sf_dir), cheating=True, min_chars=100)


@query(sql.ATTACHED)
def spans_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each atom's spans, relative to it, and its text with the first of them marked."""
    a = sp.attach(atoms(docs(spark, sf_dir), "nchars", N), _spans(spark, sf_dir))
    shown = F.array_join(F.transform("plag_spans", lambda x: F.concat(x.start, F.lit("-"), x.end, F.lit(":"), x.source_id)), " ")
    return a.select("doc_id", "atom_num", shown.alias("plag_spans"), sp.underline(F.col("text"), F.slice("plag_spans", 1, 1)).alias("marked"))


@query(sql.AUC)
def evaluate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.auc(_judged(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))))


@query(sql.ROC)
def evaluate_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.roc(rounded(_judged(spark, sf_dir))))


@query(sql.SWEEP)
def evaluate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = kept(_spans(spark, sf_dir), "spans")
    t = sp.truth(_pieces(spark, sf_dir), spans)
    judged = kept(t.join(_ext(spark, sf_dir).select("doc_id", "atom_num", "confidence"), ["doc_id", "atom_num"]), "judged")
    return rounded(ev.sweep(judged, spans))


@query(sql.CONFUSION)
def evaluate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.confusion(_judged(spark, sf_dir), 0.2))


@query(sql.WRONG)
def evaluate_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.wrong(_judged(spark, sf_dir).drop("start", "end"), 0.2))


@query(sql.SOURCE_ACCURACY)
def evaluate_source_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.source_accuracy(_ext(spark, sf_dir), ev.atom_truth(_pieces(spark, sf_dir), _sources_cols(_spans(spark, sf_dir)))))


@query(sql.TRANSITIONS)
def evaluate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.transitions(_truth(spark, sf_dir)))


@query(sql.T_TEST)
def evaluate_t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two documents, whatever their number of passages, by each feature: rows grow with the square of the documents, as the comparison does."""
    return rounded(ev.t_statistics(_long(spark, sf_dir)))


@query(sql.SAME_DOCUMENT)
def evaluate_same_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of each document against each other."""
    return rounded(ev.same_document(_long(spark, sf_dir)))


@query()
def evaluate_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.with_p_values(ev.same_document(_long(spark, sf_dir))))


@query(sql.PAIRWISE)
def evaluate_pairwise_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths = _truth(spark, sf_dir).select("doc_id", "atom_num", F.col("truth").alias("actual"))
    return rounded(ev.pairwise_aucs(_long(spark, sf_dir), truths, sql.FEATURES5))


@query(sql.OVERLAPS)
def evaluate_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.overlap_rows(_judged(spark, sf_dir).where("confidence > 0.2"), _spans(spark, sf_dir))


@query(sql.LABEL_AUC)
def evaluate_document_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a document's highest outlier score tells the documents labelled poor."""
    scores = sc.outlier(_long(spark, sf_dir)).groupBy("doc_id").agg(F.round(F.max("confidence"), 9).alias("confidence"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("actual"))
    return rounded(ev.auc(scores.join(labels, "doc_id")))


@query(sql.STATISTICS)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.corpus_statistics(docs(spark, sf_dir), _spans(spark, sf_dir)))


@query(sql.COMBINED)
def combine_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cb.combine(sc.outlier(_long(spark, sf_dir)), _ext(spark, sf_dir))
    i, e = F.col("intrinsic"), F.col("extrinsic")
    means = {"arithmetic": "arithmetic", "geometric": "geometric", "largest": "max", "smallest": "min", "total": "sum"}
    return rounded(c.select("doc_id", "atom_num", "intrinsic", "extrinsic", *(cb.MEANS[m](i, e).alias(n) for n, m in means.items()), cb.power_mean(i, e, 2).alias("power2")))


@query(sql.THREE)
def combine_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cb.combine(sc.outlier(_long(spark, sf_dir)), _ext(spark, sf_dir))
    c = c.select("doc_id", "atom_num", *(F.round(x, 9).alias(x) for x in ("intrinsic", "extrinsic", "confidence")))
    return rounded(cb.three_aucs(c, _truth(spark, sf_dir)))


@query(f"WITH {sql.BASE}, {sql.outlier()} SELECT doc_id, atom_num, round(confidence, 6) AS confidence FROM scored WHERE confidence > 0.85")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cb.analyze(sc.outlier(_long(spark, sf_dir))))


@query(sql.SPLIT)
def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.split(docs(spark, sf_dir)).select("doc_id", "part")


@query(sql.EXACT_SPLIT)
def corpus_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.exact_split(docs(spark, sf_dir)).select("doc_id", "part")


@query(sql.WITH_SOURCES)
def corpus_split_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.split_with_sources(docs(spark, sf_dir), _spans(spark, sf_dir))


@query(sql.CRISP)
def corpus_crisp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects of at most 20 lines whose sources have no more (the texts have no blank lines)."""
    d = docs(spark, sf_dir)
    counts = atoms(d, "line").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    spans, own = _spans(spark, sf_dir), items(spark, sf_dir).select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    # items and documents both count from 0: sources get ids of their own
    sources = own.select((-1 - F.col("doc_id")).alias("id"), F.col("n").cast("bigint").alias("n"))
    return cp.crisp(d, spans.withColumn("source_id", -1 - F.col("source_id")), counts.unionByName(sources), 20)


@query(sql.VARIABLE)
def corpus_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.variable_corpus(docs(spark, sf_dir), _spans(spark, sf_dir))


@query(sql.TEST_CORPUS)
def corpus_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return cp.test_corpus(d, kept(_spans(spark, sf_dir), "spans"), cp.split(d).where("part = 'training'"))


@query(sql.PREFIX)
def corpus_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.prefix_corpus(docs(spark, sf_dir), _spans(spark, sf_dir))


@query(sql.SAMPLE)
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.sample(docs(spark, sf_dir), _spans(spark, sf_dir), 50)


@query(sql.TRAINING_FILES)
def corpus_training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.training_files(docs(spark, sf_dir), _spans(spark, sf_dir), 100, least_chars=200, plag_share=0.2)


@query(sql.TAG_TRIGRAMS)
def corpus_tag_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.tag_trigrams(docs(spark, sf_dir))


@query(sql.TAG_TRIGRAM_DOCS)
def corpus_tag_trigram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.tag_trigram_documents(docs(spark, sf_dir))


def _trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their truth, written once: the searches read them in every round."""
    f = ft.word_features(docs(spark, sf_dir), sql.FEATURES5, n=N)
    t = _truth(spark, sf_dir).select("doc_id", "atom_num", F.col("truth").alias("actual"))
    return Scratch(spark, "models").keep(f.join(t, ["doc_id", "atom_num"]), "table")


@query()
def model_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the logistic regression over features, on the rows that it was fitted on."""
    t = _trainable(spark, sf_dir)
    model, _ = ml.logistic(t, sql.FEATURES5, balanced=True)
    return rounded(ev.auc(ml.logistic_scores(model, t)))


@query()
def model_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ml.stepwise(_trainable(spark, sf_dir), sql.FEATURES5)
    return spark.createDataFrame([(k, f, float(a)) for k, (f, a) in enumerate(chosen, 1)], "step int, feature string, auc double")


@query()
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, score = ml.evolve_weights(_trainable(spark, sf_dir), sql.FEATURES5)
    return spark.createDataFrame([(f, float(w), float(score)) for f, w in zip(sql.FEATURES5, weights)], "feature string, weight double, auc double")


@query()
def model_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula, score = ml.evolve_formula(_trainable(spark, sf_dir), sql.FEATURES5)
    return spark.createDataFrame([(ml.formula_sql(formula), float(score))], "formula string, auc double")


@query()
def model_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, _ = ml.train_network(_trainable(spark, sf_dir), sql.FEATURES5)
    return rounded(sc.network_confidences(_long(spark, sf_dir), net))


@query()
def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of each scoring method against the same truth."""
    long = kept(_long(spark, sf_dir), "vectors")
    methods = ["kmeans", "kmedians", "agglom", "hmm"]
    scored = sc.clusters(long, methods).join(sc.outlier(long).withColumnRenamed("confidence", "outlier"), ["doc_id", "atom_num"])
    judged = scored.join(_truth(spark, sf_dir).select("doc_id", "atom_num", F.col("truth").alias("actual")), ["doc_id", "atom_num"])
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("confidence")) for m in ["outlier", *methods])))
    return rounded(ev.auc(judged.select("actual", each.alias("s")).select("actual", "s.method", "s.confidence"), ["method"]))


@query()
def compare_methods_on_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of scoring methods on made-up passages whose plagiarised ones lie apart; reads no table."""
    c = kept(cp.gaussian_clouds(prepare(spark), 90, 10, 3.0, dimensions=3, documents=20), "clouds")
    scored = None
    for method in ("outlier", "kmeans", "kmedians", "agglom"):
        one = sc.cluster(c.drop("actual"), method).select("doc_id", "atom_num", F.lit(method).alias("method"), F.round("confidence", 9).alias("confidence"))
        scored = one if scored is None else scored.unionByName(one)
    return rounded(ev.auc(scored.join(c.select("doc_id", "atom_num", "actual").distinct(), ["doc_id", "atom_num"]), ["method"]))
