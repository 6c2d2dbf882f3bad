"""Steps whose memory, time or numbers once grew faster than their tables."""

from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemmata.functions import lexicon as lx
from stemmata.functions import cluster, style
from stemmata.functions import fingerprint as fp
from stemmata.functions import tokenize as tk
from stemmata.operators import evaluate, features, fingerprints, models, scoring, search
from stemmata.operators import atoms as at
from stemmata.operators.atoms import atoms


def test_tag_trigrams_of_a_worker_that_knows_many_words():
    lexicon = lx.Lexicon()
    texts = ["He walked home with the dogs."] * 400
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    want = next(features._tag_trigrams(iter([batch]), lexicon)).to_pylist()
    words = style.words_of(lexicon)
    words.ids([f"word{k}" for k in range(350_000)])  # 400 texts times the third power of these is beyond 64 bits
    try:
        got = next(features._tag_trigrams(iter([batch]), lexicon)).to_pylist()
    finally:
        words.clear()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) >= 400


def _corpus(spark):
    rng = np.random.default_rng(8)
    words = ["ab", "cde", "fghi", "ul", "xyzzy", "Q.", "n"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(k, text(int(rng.integers(0, 60)))) for k in range(30)] + [(3, text(50)), (3, text(20)), (4, text(30)), (None, "ab"), (40, None), (41, "")]
    items = [(k, text(int(rng.integers(3, 12)))) for k in range(12)] + [(5, text(9))]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "doc_id bigint, text string")


@pytest.mark.parametrize("limit", [0, search.BROADCAST_BYTES])
def test_searches_of_texts_are_searches(spark, monkeypatch, limit):
    """In the task that reads the texts or by joins: the rows of the joined search, repeated ids and all."""
    docs, items = _corpus(spark)
    span = 40  # so that hashes, 0 too, are shared by many
    m = search.Method("winnow-k", 4, 6, "nchars", 40, span)
    sources = fingerprints.fingerprints(items, "winnow-k", 4, 6, span=span)
    prints, whole, pieces = m.prints(docs), fingerprints.fingerprints(docs, "winnow-k", 4, 6, span=span), atoms(docs, "nchars", 40)
    rows = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    for measure in search.SIMILARITIES:
        assert rows(search.search_texts(docs, m, sources, measure)) == rows(search.search(prints, sources, measure, pieces))
        assert rows(search.search_among_texts(sources, docs, m, measure)) == rows(search.search(sources, prints, measure))
    short = pieces.where("end - start < 45")
    assert rows(search.search_texts(docs, m, sources, least=45)) == rows(search.search(prints, sources, passages=pieces, short=short))
    assert rows(search.two_level_texts(docs, m, sources, search_n=2)) == rows(search.two_level(whole, sources, prints, sources, search_n=2))
    assert rows(search.two_level_texts(docs, m, sources, search_n=2, passages_first=True)) == rows(search.two_level(prints, sources, prints, sources, search_n=2, passages_first=True))


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_small_sides_are_not_met_by_a_shuffle(spark):
    docs, items = _corpus(spark)
    docs = docs.where("doc_id > 4")
    m = search.Method("winnow-k", 4, 6, "nchars", 40)
    sources = fingerprints.fingerprints(items, "winnow-k", 4, 6)
    assert _shuffles(search.search_texts(docs, m, sources)) == 0
    assert _shuffles(search.two_level_texts(docs, m, sources)) == 0
    assert _shuffles(search.occurrences(docs, items.withColumnRenamed("doc_id", "item_id"))) == 0


def test_clusterings_of_many_documents_in_one_shuffle(spark):
    rng = np.random.default_rng(5)
    rows = [(d, a, f, float(rng.integers(0, 5))) for d in range(40) for a in range(int(rng.integers(1, 12))) for f in ("x", "y")]
    rng.shuffle(rows)
    long = spark.createDataFrame([(int(d), int(a), str(f), float(v)) for d, a, f, v in rows], "doc_id bigint, atom_num int, feature string, value double")
    methods = ["kmeans", "kmedians", "agglom", "hmm"]
    got = scoring.clusters(long, methods)
    assert _shuffles(got) == 1
    by = {(r.doc_id, r.atom_num): r for r in got.collect()}
    held = {(int(d), int(a), str(f)): float(v) for d, a, f, v in rows}
    assert len(by) == len(held) // 2
    for d in range(40):
        n = sum(k[0] == d for k in by)
        x = np.array([[held[d, a, f] for f in ("x", "y")] for a in range(n)])
        for m in methods:
            assert [by[d, a][m] for a in range(n)] == cluster.METHODS[m](x).tolist()
    one = scoring.cluster(long, "hmm")
    assert {(r.doc_id, r.atom_num): r.confidence for r in one.collect()} == {k: r.hmm for k, r in by.items()}


def test_two_states_as_many():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30):
        emit = np.round(rng.normal(size=(n, 2)), 1)  # rounded: ties occur
        path, likely = cluster.viterbi(emit, cluster.STAY, np.log(np.full(2, 0.5)))
        wide = np.column_stack([emit, np.full(n, -1e9)])  # a third state that is never taken goes the general way
        move = np.full((3, 3), -1e9)
        move[:2, :2] = cluster.STAY
        path3, likely3 = cluster.viterbi(wide, move, np.log(np.array([0.5, 0.5, 1e-300])))
        assert path.tolist() == path3.tolist() and likely == likely3


def test_t_statistics_in_blocks(spark):
    rng = np.random.default_rng(7)
    long = spark.createDataFrame([(d, a, f, float(rng.integers(0, 9))) for d in range(23) for a in range(3) for f in ("x", "y")], "doc_id bigint, atom_num int, feature string, value double")
    rows = lambda df: sorted(map(str, df.collect()))
    one, many = evaluate.t_statistics(long), evaluate.t_statistics(long, block=4)
    assert rows(one) == rows(many) and many.count() == 2 * 23 * 22 // 2
    assert "hashpartitioning(feature" in many._jdf.queryExecution().executedPlan().toString() and ", i#" in many._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_in_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c"), (2, "b c d"), (2, "b c d e"), (3, "a b c"), (None, "a b c"), (4, None), (5, "")], "doc_id bigint, text string")
    old = fingerprints.chosen_grams(docs, "full", 3).groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    assert sorted(map(str, fingerprints.gram_counts(docs, "full", 3).collect())) == sorted(map(str, old.collect()))
    assert _shuffles(fingerprints.gram_counts(docs.where("doc_id <> 2"), "full", 3)) == 1


def test_aucs_of_a_round_without_a_shuffle_of_passages(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(rng.random() < share), float(rng.integers(0, 6)), None if rng.random() < 0.1 else float(rng.normal())) for share in (0.2, 0.8) for _ in range(150)]
    columns = [F.col("x"), F.col("y"), F.col("x") * 2 - F.col("y"), F.lit(1.0)]
    for some in (rows[:150], rows[150:], [r for r in rows if r[0]]):
        judge = models._Judge(spark.createDataFrame(some, "actual int, x double, y double"))
        assert judge.aucs(columns) == judge.by_sorting(columns)
    monkeypatch.setattr(models._Judge, "by_sorting", lambda *_: 1 / 0)
    t = spark.createDataFrame(rows, "actual int, x double, y double")
    assert len(models.evolve_weights(t, ["x", "y"], population=4, generations=3)[0]) == 2


def test_background_as_digests(spark, monkeypatch):
    """The classes of the table of words, of that of digests and of the join are alike; digests take no shuffle by document."""
    rng = np.random.default_rng(10)
    words = [f"w{int(k)}" for k in rng.zipf(1.5, 4000) % 1500]
    docs = spark.createDataFrame([(d, " ".join(words[d * 100 : d * 100 + 100]) + " once%d ." % d) for d in range(40)], "doc_id bigint, text string")
    name = ["avg_external_word_freq_class", "std(avg_external_word_freq_class)"]
    made = lambda: features.features(docs, name)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(made())
    monkeypatch.setattr(features, "BROADCAST_BYTES", 4000)
    assert _shuffles(made()) == 0 and rows(made()) == want
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    assert _shuffles(made()) > 0 and rows(made()) == want


def test_pieces_of_many_texts_are_winnowed_together():
    rng = np.random.default_rng(11)
    words = ["ab", "cde.", "Fghi", "ul", "xyzzy", "-", "n", "é", "😀", "..."]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(60)]
    texts += ["", "...", "ΑΣ ΟΔΟΣ. " * 20, "İstanbul abcdefghijkl " * 9, "\U0010ffff" + "abcdefghijklmn" * 9]  # a sigma's lower case depends on what follows; one letter becomes two; bits don't suffice
    for n, k, span, size in ((8, 13, fp.WIDE, 50), (4, 6, 40, 40), (1, 1, 40, 40), (3, 3, fp.SPAN, 70), (8, 13, fp.SPAN, 10**9)):
        cuts = [tk.nchars(t, size) for t in texts]
        owner, hashes = fp.winnowed(texts, cuts, n, k, span)
        assert (np.diff(owner) >= 0).all()
        want = [fp.fingerprint(t[a:b], "winnow-k", n, k, span) for t, c in zip(texts, cuts) for a, b in c]
        assert [np.unique(hashes[owner == j]).tolist() for j in range(len(want))] == want


def test_passages_are_not_hashed_and_met_one_by_one(spark, monkeypatch):
    """Sources that say the same are met once, and blocks of meetings change nothing."""
    docs, items = _corpus(spark)
    docs = docs.where("doc_id > 4")
    m = search.Method("winnow-k", 4, 6, "nchars", 40, 40)
    again = items.where("doc_id <> 5").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    sources = fingerprints.fingerprints(again.select((F.col("doc_id") + 100 * F.col("k")).alias("doc_id"), "text"), "winnow-k", 4, 6, span=40)
    prints, rows = m.prints(docs), lambda df: sorted(map(str, df.collect()))
    want = rows(search.two_level(prints, sources, prints, sources, search_n=3, passages_first=True))
    assert len(search._index(sources)[1].value.ids) == 20 * len(search._index(sources, 1)[1].value.ids)
    assert len(search._index(sources, 3)[1].value.ids) == 3 * len(search._index(sources, 1)[1].value.ids)
    several = sources.withColumn("atom_num", F.col("doc_id").cast("int")).withColumn("doc_id", F.lit(1).cast("bigint"))
    assert len(search._index(several, 3, by_id=True)[1].value.ids) == len(search._index(several)[1].value.ids)
    assert rows(search.two_level_texts(docs, m, sources, search_n=3, passages_first=True)) == want
    index = search._index(sources, 3)[1]
    batch = docs.where("text IS NOT NULL").toArrow().to_batches()
    monkeypatch.setattr(search.fp, "fingerprint", lambda *_: 1 / 0)
    for first in ("", "document", "passage"):
        found = []
        for pairs in (1 << 20, 1, 7):
            monkeypatch.setattr(search, "PAIRS", pairs)
            found.append([b.to_pylist() for b in search._suspects(iter(batch), m, index, "jaccard", 0, True, first, 3)])
        assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("limit, most", [(0, at.SIDE_BY_SIDE), (at.BROADCAST_BYTES, 200)])
def test_texts_of_a_repeated_id_meet_in_one_task(spark, monkeypatch, limit, most):
    """Only hashes of an id with too much text for a task are shuffled and joined."""
    docs, items = _corpus(spark)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") > 6, F.col("doc_id") % 13).otherwise(F.col("doc_id"))).repartition(5)
    m = search.Method("winnow-k", 4, 6, "nchars", 40, 40)
    sources = fingerprints.fingerprints(items, "winnow-k", 4, 6, span=40)
    prints, whole, pieces = m.prints(docs), fingerprints.fingerprints(docs, "winnow-k", 4, 6, span=40), atoms(docs, "nchars", 40)
    rows = lambda df: sorted(map(str, df.collect()))
    short = pieces.where("end - start < 45")
    want = [
        rows(search.search(prints, sources, "jaccard", pieces, short=short)),
        rows(search.search(sources, prints, "jaccard")),
        *(rows(search.two_level(prints if f else whole, sources, prints, sources, search_n=2, passages_first=f)) for f in (False, True)),
    ]
    monkeypatch.setattr(at, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(search, "side_by_side", partial(at.side_by_side, most=most))
    if most > 200:
        for joined in ("search", "two_level", "candidates"):
            monkeypatch.setattr(search, joined, lambda *_, **__: 1 / 0)
    assert rows(search.search_texts(docs, m, sources, "jaccard", least=45)) == want[0]
    assert rows(search.search_among_texts(sources, docs, m, "jaccard")) == want[1]
    assert [rows(search.two_level_texts(docs, m, sources, search_n=2, passages_first=f)) for f in (False, True)] == want[2:]


def test_an_id_is_not_cut_by_batches_and_chunks(spark, monkeypatch):
    docs, items = _corpus(spark)
    m = search.Method("winnow-k", 4, 6, "nchars", 40, 40)
    index = search._index(fingerprints.fingerprints(items, "winnow-k", 4, 6, span=40))[1]
    table = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("doc_id", F.col("doc_id") % 13).orderBy("doc_id", "text").toArrow()
    found = []
    for chunk, batch in ((1 << 18, 1000), (1, 1000), (1, 1), (300, 2)):
        monkeypatch.setattr(search, "CHUNK", chunk)
        found.append([r for b in search._suspects(iter(table.to_batches(batch)), m, index, "jaccard", 0, True, "", 0) for r in b.to_pylist()])
    assert found[0] and found[0] == found[1] == found[2] == found[3]
