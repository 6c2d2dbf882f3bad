import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemmata.functions import fingerprint as fp
from stemmata.functions import lexicon
from stemmata.functions.network import Network
from stemmata.operators import combine, corpus, evaluate, features, fingerprints, models, scoring, search, spans
from stemmata.operators.atoms import atoms
from stemmata.sources import files

TEXT = "The brown fox ate. Believe it. I go to the school."


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame([(1, TEXT), (None, "x"), (2, None)], "doc_id bigint, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("atom_num").collect()]


def test_features(doc, spark):
    w = features.word_features(doc, ["num_chars", "word_unigram,the", "stopword_percentage"], "sentence")
    assert column(w, "num_chars") == [15, 10, 15] and column(w, "word_unigram,the") == [1, 0, 1]
    assert column(features.char_features(doc, "sentence"), "punctuation_percentage") == pytest.approx([1 / 18, 1 / 11, 1 / 19])
    s = features.sentence_features(doc, "paragraph")
    assert column(s, "average_sentence_length") == pytest.approx([11 / 3])
    n = features.nested_features(doc, ["avg(num_chars)"], "sentence")
    assert column(n, "avg(num_chars)") == [15, 10, 15]
    n = features.nested_features(doc, ["avg(num_chars)", "std(num_chars)", "avg(std(num_chars))", "avg(avg(num_chars))", "avg(average_sentence_length)", "std(average_sentence_length)"], "paragraph")
    r = n.first()
    sd = float(np.std([15, 10, 15]))
    assert [r[c] for c in n.columns[2:]] == pytest.approx([40 / 3, sd, sd, 40 / 3, 11 / 3, 0.0])
    d = spark.createDataFrame([(1, "The mad hatter likes tea and the red queen hates alice.")], "doc_id bigint, text string")
    assert column(features.char_features(d, "sentence"), "vowelness_trigram,C,V,C") == [9]


def plain_nested(name, words, sentences, paragraphs):
    """A nested name of a whole text by its definition; units are lists of words, a paragraph's of its sentences."""
    *wrappers, base = features.parse(name)
    value = {
        "num_chars": lambda w: sum(map(len, w)), "average_syllables_per_word": lambda w: sum(len(x) % 3 for x in w) / len(w), "stopword_percentage": lambda w: np.mean([lexicon.Lexicon.norm(x) in lexicon.STOP for x in w]),
        "syntactic_complexity": lambda w: sum(2 * (n in lexicon.SUBORDINATING) + 2 * (t in lexicon.WH) + t.startswith("VB") for n, t in ((lexicon.Lexicon.norm(x), lexicon.Lexicon().tag(x, lexicon.Lexicon.norm(x))) for x in w)),
    }
    count = Counter(lexicon.Lexicon.norm(w) for w in words)
    value["avg_internal_word_freq_class"] = lambda w: np.mean([math.floor(math.log2(max(count.values()) / count[lexicon.Lexicon.norm(x)])) for x in w])
    value["avg_external_word_freq_class"] = lambda w: np.mean([math.floor(math.log2((max(count.values()) + 1) / (count[lexicon.Lexicon.norm(x)] + 1))) for x in w])
    flat = lambda units: [w for u in units for w in u]
    if base == "average_sentence_length":
        per = [len(flat(p)) / len(p) for p in paragraphs]
        return np.std(per) if wrappers == ["std"] else len(words) / len(sentences) / len(paragraphs)
    if base == "syntactic_complexity_average":
        per = [value["syntactic_complexity"](flat(p)) / len(p) for p in paragraphs]
        return np.std(per) if wrappers == ["std"] else value["syntactic_complexity"](words) / len(sentences) / len(paragraphs)
    spread = np.std([value[base](s) for s in sentences])
    one = {("avg",): value[base](words) / len(sentences), ("std",): spread}
    return one[tuple(wrappers)] if len(wrappers) == 1 else (spread if wrappers[1] == "std" else one["avg",]) / len(paragraphs)


def test_every_name_in_one_pass(spark):
    """All of the catalogue at once equals each name by itself, and the 28 nested names their definitions."""
    paragraphs = [[["The", "dog", "barked", "while", "it", "was", "running", "."], ["Who", "said", "that", "?"]], [["Since", "then", "the", "cats", "of", "York", "have", "been", "quiet", "."], ["No", "dog", "barked", "."], ["It", "is", "the", "end", "."]]]
    text = "\n\n".join(" ".join(" ".join(s[:-1]) + s[-1] for s in p) for p in paragraphs)
    glued = [[[*s[:-2], s[-2] + s[-1]] if s[-1] == "." else s for s in p] for p in paragraphs]  # a final period stays with its word
    sentences = [s for p in glued for s in p]
    words = [w for s in sentences for w in s]
    d = spark.createDataFrame([(1, text), (2, ""), (3, "   ")], "doc_id bigint, text string")
    names = features.catalogue()
    f = spark.createDataFrame([(w, n) for w, n in Counter(lexicon.Lexicon.norm(w) for w in words).items()], "word string, n bigint")
    whole = {r.doc_id: r for r in features.features(d, names, "full", frequencies=f).collect()}
    for name in names:
        if "(" in name:
            assert whole[1][name] == pytest.approx(plain_nested(name, words, sentences, glued)), name
    assert whole[2]["num_chars"] is None and whole[2]["punctuation_percentage"] == 0
    for name in ("num_chars", "yule_k_characteristic", "flesch_reading_ease", "evolved_feature_four", "avg(avg(stopword_percentage))", "avg_external_word_freq_class"):
        assert {r.doc_id: r[name] for r in features.features(d, [name], "full", frequencies=f).collect()} == {k: pytest.approx(r[name]) for k, r in whole.items() if r[name] is not None}


def test_features_of_odd_tables(spark, monkeypatch):
    long = "Many words of a very long text go on. " * 3000
    rows = [(1, TEXT, 0, "x"), (1, TEXT, 0, "x"), (1, "Other text.", 1, "x"), (None, "x", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, long, 0, "x"), (5, "\u212a\u0130 \U0001f600.", 0, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, atom_num int, num_chars string")
    got = sorted((r.doc_id, r.atom_num, r.num_chars) for r in features.features(d, ["num_chars"], "full").collect())
    assert got == [(1, 0, 10.0), (1, 0, 40.0), (1, 0, 40.0), (4, 0, 3000 * 29.0), (5, 0, 4.0)]  # rows with one doc_id aren't merged
    assert features.features(d.limit(0), features.catalogue(), "full").count() == 0
    # the background table joined instead of sent
    names = ["avg_external_word_freq_class", "std(avg_external_word_freq_class)"]
    key = lambda r: (r[0], r[1], r[2] or 0, r[3] or 0)
    sent = sorted(features.features(d, names).collect(), key=key)
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    assert sorted(features.features(d, names).collect(), key=key) == sent and len(sent) > 5


def test_own_resources(spark):
    table = lambda rows, *names: spark.createDataFrame(rows, ", ".join(names))
    own = lexicon.Lexicon.of(
        stop=table([("Fox",), (None,)], "word string"), stems=table([("ate", "eat"), ("eats", "eat")], "word string", "stem string"), syllables=table([("brown", 1), ("brown", 3), ("ate", 1)], "word string", "syllables int"),
        tags=table([("believe", "NNP")], "word string", "tag string"),
    )
    d = spark.createDataFrame([(1, "The brown fox ate. He eats. Believe it.")], "doc_id bigint, text string")
    r = features.features(d, ["stopword_percentage", "average_syllables_per_word", "yule_k_characteristic", "syntactic_complexity"], "full", lexicon=own).first()
    assert r.stopword_percentage == 1 / 8 and r.average_syllables_per_word == (0 + 1 + 0 + 1 + 2 + 2 + 1 + 0) / 8
    assert r.yule_k_characteristic == pytest.approx(10000 * (6 + 4 - 7) / 49)
    assert lexicon.Lexicon().tag("Believe", "believe") == "NP" and own.tag("Believe", "believe") == "NNP"


def test_subsets():
    assert {k: len(set(v)) for k, v in features.SUBSETS.items()} == {"study": 7, "training": 19, "test": 29}
    assert set(features.SUBSETS["training"]) < set(features.SUBSETS["test"]) <= set(features.catalogue())


def test_feature_names():
    assert features.parse("avg(std(num_chars))") == ["avg", "std", "num_chars"]
    assert len([x for x in features.catalogue() if "(" in x]) == 28
    for bad in ("avg(num_chars", "sum(num_chars)", "num_chars)"):
        with pytest.raises(ValueError):
            features.parse(bad)
    with pytest.raises(ValueError):
        features.level("nothing")


def test_spans(spark):
    a = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (2, 0, 0, 5)], "doc_id bigint, atom_num int, start int, end int")
    s = spark.createDataFrame([(1, 8, 12, 7), (1, 19, 19, 7)], "doc_id bigint, start int, end int, source_id bigint")
    assert sorted((r.doc_id, r.atom_num, r.truth, r.n_plag) for r in spans.truth(a, s).collect()) == [(1, 0, 1, 2), (1, 1, 1, 2), (2, 0, 0, 0)]
    assert sorted((r.doc_id, r.atom_num) for r in spans.truth(a, s, cheating=True, min_chars=6).collect()) == []
    got = {(r.doc_id, r.atom_num): [(x.start, x.end) for x in r.plag_spans] for r in spans.attach(a, s).collect()}
    assert got == {(1, 0): [(8, 10)], (1, 1): [(0, 2)], (2, 0): []}
    d = spark.createDataFrame([("abcdef", [(1, 2), (3, 5)])], "text string, s array<struct<start:int,end:int>>")
    assert d.select(spans.underline(F.col("text"), F.col("s"))).first()[0] == "a_b_c_de_f"


def test_outlier(spark):
    values = {0: [5.0, 5.1, 4.9, 5.0, 9.0, 5.2, 4.8], 1: [1.0] * 7}
    rows = [(1, i, f"f{f}", v) for f, vs in values.items() for i, v in enumerate(vs)] + [(2, 0, "f0", 1.0), (2, 1, "f0", 3.0)]
    long = spark.createDataFrame(rows, "doc_id bigint, atom_num int, feature string, value double")
    got = {(r.doc_id, r.atom_num): r.confidence for r in scoring.outlier(long).collect()}
    kept = sorted(values[0])[1:-1]
    mean, sd = np.mean(kept), np.std(kept)
    for i, v in enumerate(values[0]):
        off, u = abs(v - mean), 1 / (9.0 - 4.8)
        g = max(math.exp(-0.5 * (off / sd) ** 2) / (sd * math.sqrt(2 * math.pi)), 1e-30)
        assert got[1, i] == pytest.approx(0.2 if sd <= off <= 2 * sd else u / (u + g))
    assert got[2, 0] == got[2, 1] == 0.2
    assert {r.confidence for r in scoring.cluster(long.where("feature = 'f1'"), "median_simple").collect()} == {0.0}
    with pytest.raises(ValueError):
        scoring.cluster(long, "nothing")
    shares = {(r.removed, r.doc_id): r.share for r in scoring.unmask(long, ["f0", "f1"]).collect()}
    assert shares["control", 1] == pytest.approx(1 / 7) and shares["f0", 1] == 0


def test_network_in_sql(spark):
    rng = np.random.default_rng(0)
    net = Network(rng.normal(size=(4, 2)), rng.normal(size=4), rng.normal(size=(1, 4)), rng.normal(size=1))
    long = spark.createDataFrame([(1, i, f, float(i + k)) for i in range(3) for k, f in enumerate("ab")], "doc_id bigint, atom_num int, feature string, value double")
    got = column(scoring.network_confidences(long, net), "confidence")
    assert got == pytest.approx(net(np.array([[i, i + 1.0] for i in range(3)]))[:, 0].tolist())


def test_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    prints = lambda ids, lo: [(d, a, int(h)) for d in ids for a in range(2) for h in set(rng.integers(lo, 12, 6).tolist())]
    schema = "doc_id bigint, atom_num int, hash_value bigint"
    a_rows, b_rows = prints(range(4), 0), prints(range(10, 15), 0)
    a, b = spark.createDataFrame(a_rows + [(9, 0, 99)], schema), spark.createDataFrame(b_rows, schema)
    sets = lambda rows: {k: {h for d, n, h in rows if (d, n) == k} for k in {(d, n) for d, n, _ in rows}}
    sa, sb = sets(a_rows), sets(b_rows)
    for measure in search.SIMILARITIES:
        got = {(r.doc_id, r.atom_num): (r.source_id, r.source_atom, r.confidence) for r in search.search(a, b, measure).collect()}
        for k, x in sa.items():
            best = []
            for m, y in sb.items():
                if (x & y) - {0}:
                    c = len(x & y)
                    v = c / len(x) if measure.startswith("c") else c / len(x | y)
                    best.append((-(0 if measure.endswith("alt1") and c < 2 else v), *m))
            v, d, n = min(best)
            assert got[k][:2] == (d, n) and got[k][2] == pytest.approx(-v)
        assert got[9, 0] == (None, None, 0.0)
    path = str(tmp_path / "index")
    search.write_index(a, path, "m", False)
    search.write_index(a, path, "m", False)
    assert search.read_index(spark, path, "m", False).count() == a.count()
    assert search.populated(a).first().documents == 5
    with pytest.raises(ValueError):
        search.require_populated(a, b.limit(0))
    assert search.two_level(a, b, a, b, search_n=1, passages_first=True).count() == 9
    assert search.with_fingerprints(search.lookup(b, a), b).count() == 10


def test_occurrences_at_every_place(spark):
    long = "the quick brown fox jumps over a lazy dog near the river bank"
    d = [(1, f"é {long}. {long}\n{long}"), (2, "aXaXaXa"), (3, long[5:])]
    p = [(10, long), (11, "aXaXa")]
    got = search.occurrences(spark.createDataFrame(d, "doc_id bigint, text string"), spark.createDataFrame(p, "item_id bigint, text string")).collect()
    n = len(long)
    assert sorted(map(tuple, got)) == [*((1, 10, s, s + n) for s in (2, n + 4, 2 * n + 5)), (2, 11, 0, 5), (2, 11, 2, 7)]


def test_occurrences(spark):
    p = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "short one"), (3, ""), (4, None)]
    d = [(1, "x " + p[0][1] + " y"), (2, p[0][1]), (3, "a short one here"), (4, "alpha beta gamma delta"), (5, None), (6, "")]
    got = search.occurrences(spark.createDataFrame(d, "doc_id bigint, text string"), spark.createDataFrame(p, "item_id bigint, text string"))
    n = len(p[0][1])
    assert sorted((r.doc_id, r.source_id, r.start, r.end) for r in got.collect()) == [(1, 1, 2, 2 + n), (2, 1, 0, n), (3, 2, 2, 11)]


def test_quality(spark):
    s = spark.createDataFrame([(1, a, b) for a, b in ((10, 21), (32, 40), (51, 57))], "doc_id bigint, start int, end int")
    d = spark.createDataFrame([(1, a, b) for a, b in ((22, 34), (45, 55))], "doc_id bigint, start int, end int")
    r = evaluate.spans_quality(d, s, ["doc_id"]).first()
    assert (r.recall, r.precision, r.granularity) == pytest.approx(((2 / 8 + 4 / 6) / 3, (2 / 12 + 4 / 10) / 2, 1))
    assert r.f_measure == pytest.approx(2 * r.recall * r.precision / (r.recall + r.precision)) and r.overall == pytest.approx(r.f_measure)
    whole = spark.createDataFrame([(1, 0, 65)], d.schema)
    r = evaluate.spans_quality(whole, s, ["doc_id"]).first()
    assert (r.recall, r.precision, r.granularity) == pytest.approx((1, 25 / 65, 1))
    r = evaluate.spans_quality(d.limit(0), s, ["doc_id"]).first()
    assert r.precision is None and r.recall == 0
    # two equal detections count twice
    r = evaluate.spans_quality(whole.unionByName(whole), s, ["doc_id"]).first()
    assert r.granularity == 2 and r.recall == pytest.approx(2)


def test_auc(spark):
    rng = np.random.default_rng(0)
    y, c = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 8
    t = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, c)], "actual int, confidence double")
    p, n = c[y == 1], c[y == 0]
    want = np.mean((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None]))
    assert evaluate.auc(t).first().auc == pytest.approx(want)
    points = [(0, 0)] + [(r.fpr, r.tpr) for r in evaluate.roc(t).orderBy(F.desc("threshold")).collect()]
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])) == pytest.approx(want)
    assert evaluate.auc(t.where("actual = 1")).first().auc is None
    bands = evaluate.auc_bands(spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.9)], "feature_a string, feature_b string, auc double"))
    assert max(r.z for r in bands.collect()) == pytest.approx(2**0.5)
    g = spark.createDataFrame([("x", True, 0.7), ("x", False, 0.6), ("y", True, 0.9)], "setting string, cheating boolean, auc double")
    assert evaluate.gain(g).first().gain == pytest.approx(0.1)


def test_combine_and_models(spark):
    rng = np.random.default_rng(0)
    rows = [(k, 0, int(k % 3 == 0), float(k % 3 == 0) + rng.normal(0, 0.3), rng.normal()) for k in range(120)]
    t = spark.createDataFrame(rows, "doc_id bigint, atom_num int, actual int, good double, noise double")
    model, weights = models.logistic(t, ["good", "noise"], balanced=True)
    assert evaluate.auc(models.logistic_scores(model, t)).first().auc > 0.9 and abs(weights["good"]) > abs(weights["noise"])
    assert models.stepwise(t, ["noise", "good"])[0][0] == "good"
    w, a = models.evolve_weights(t, ["good", "noise"], population=4, generations=2)
    assert len(w) == 2 and a > 0.5
    f, a = models.evolve_formula(t, ["good", "noise"], population=4, children=4, generations=2, depth=3)
    assert a >= 0.5 and models.evaluate_formula(t, f).where("confidence IS NULL").count() == 0
    assert models.evaluate_formula(t, ("**", -1.0, 0.5)).first().confidence == 1e255
    net, loss = models.train_network(t, ["good", "noise"])
    assert loss < 0.25
    i = t.select("doc_id", "atom_num", F.lit(0.2).alias("confidence"))
    e = t.select("doc_id", "atom_num", F.lit(0.8).alias("confidence"))
    for how, want in (("arithmetic", 0.5), ("max", 0.8), ("min", 0.2), ("sum", 1.0), ("power1", 0.501)):
        assert combine.combine(i, e, how).first().confidence == pytest.approx(want)
    with pytest.raises(ValueError):
        combine.combine(i, e, "nothing")


def test_corpus(spark):
    d = spark.createDataFrame([(k, "t" * k) for k in range(40)], "doc_id bigint, text string")
    parts = corpus.split(d, 0.7, 3)
    assert {r.doc_id: r.part for r in parts.collect()} == {r.doc_id: r.part for r in corpus.split(d.orderBy(F.desc("doc_id")), 0.7, 3).select("doc_id", "part").collect()}
    assert corpus.exact_split(d).where("part = 'training'").count() == 28
    s = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (9, 7)], "doc_id bigint, source_id bigint")
    assert [r.source_cutoff for r in corpus.variable_corpus(d, s).orderBy("rank").limit(11).collect()] == [0, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3]
    got = sorted(r.doc_id for r in corpus.test_corpus(d.where("doc_id < 10"), s, d.where("doc_id = 1").select("doc_id")).collect())
    assert got == [0, 3, 4, 5, 6, 7, 8, 9]


def test_fingerprints(spark, doc):
    got = sorted(r.hash_value for r in fingerprints.fingerprints(doc, "full", 3).collect())
    assert got == fp.fingerprint(TEXT, "full", 3)
    assert [r.gram for r in fingerprints.around_anchor(doc, "ow", 3).collect()] == ["The brown fox"]


def test_files(spark, tmp_path):
    (tmp_path / "source-document1.txt").write_text("﻿First text.\nMore.", encoding="utf-8")
    (tmp_path / "suspicious-document2.txt").write_text("Second.", encoding="utf-8")
    t = {r.name: r for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert t["source-document1"].text == "First text.\nMore." and t["source-document1"].is_source and not t["suspicious-document2"].is_source
    (tmp_path / "suspicious-document2.xml").write_text(
        '<document reference="suspicious-document2.txt"><feature name="about" authors="x" />'
        '<feature name="artificial-plagiarism" translation="false" obfuscation="high" this_offset="5" this_length="10" source_reference="source-document1.txt" source_offset="2" source_length="9" />'
        '<feature name="artificial-plagiarism" this_offset="30" this_length="4" /></document>'
    )
    a = [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "*.xml")).orderBy("start").collect()]
    assert a == [("suspicious-document2", 5, 15, "source-document1", 2, 11, "high"), ("suspicious-document2", 30, 34, None, None, None, None)]
    (tmp_path / "listing").write_text("/source-document1\nsuspicious-document2.txt\n\n")
    paths = [r.path for r in files.read_listing(spark, str(tmp_path / "listing"), "/data").collect()]
    assert sorted(paths) == ["/data/source-document1.txt", "/data/suspicious-document2.txt"]
    d = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    f = features.word_features(d, ["num_chars"], "sentence")
    cut = atoms(d, "sentence")
    truth = spans.truth(cut, spark.createDataFrame([(1, 0, 5)], "doc_id bigint, start int, end int"))
    scores = cut.select("doc_id", "atom_num", (F.col("atom_num") / 2).alias("confidence"))
    files.write_passages(f, scores, truth, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv")).orderBy("start_index").collect()
    assert back[0].asDict() == {"doc_id": 1, "start_index": 0, "end_index": 18, "num_chars": 15.0, "plag_confidence": 0.0, "contains_plag": 1}
    files.write_weights(spark, str(tmp_path / "w"), "confidence", ["a"], [2])
    assert files.read_weights(spark, str(tmp_path / "w")).first().weights == [2.0]
    html = files.passage_html(cut, truth, scores).first().html
    assert html == "<u>The brown fox ate.</u>Believe it.<mark>I go to the school.</mark>"
    assert {r.side: r.n for r in files.report(scores, cut).collect()} == {"below": 2, "above": 1}
    assert files.trial_grid(spark, n=[1, 2], k=["a", "b", "c"]).count() == 6
    files.append_results(spark.createDataFrame([(1, 0.5)], "n int, auc double"), str(tmp_path / "r"))
    files.append_results(spark.createDataFrame([(1, 0.7)], "n int, auc double"), str(tmp_path / "r"))
    assert files.oldest_trial(spark.read.parquet(str(tmp_path / "r")), ["n"]).first().auc == 0.5
    assert files.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "old")], "k int, v string"), ["k"]).count() == 2


def test_t_statistics_of_all_documents(spark, sf):
    from stemmata.plans import queries

    long = queries._long(spark, sf).toPandas()
    groups = {k: g["value"].to_numpy() for k, g in long.groupby(["feature", "doc_id"])}
    got = {(r.feature, r.doc_a, r.doc_b): r for r in queries.QUERIES["evaluate_t_statistics"](spark, sf).collect()}
    pairs = [(f, a, b) for f, a in groups for g, b in groups if f == g and a < b]
    assert set(pairs) == set(got) and min(map(len, groups.values())) < 20
    for f, a, b in pairs[::97]:
        x, y = groups[f, a], groups[f, b]
        if min(len(x), len(y)) < 2:
            assert got[f, a, b].t is None
        elif v := x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y):
            assert got[f, a, b].t == pytest.approx((x.mean() - y.mean()) / v**0.5, rel=1e-4, abs=1e-5)


def test_registered_searches_run_in_full(spark, monkeypatch):
    import inspect

    from stemmata.plans import queries

    ran = {}
    monkeypatch.setattr(queries, "_trainable", lambda *_: None)
    for name, best in (("evolve_weights", ([1.0] * 5, 0.5)), ("evolve_formula", ("num_chars", 0.5))):

        def search(*args, _of=inspect.signature(getattr(models, name)), _name=name, _best=best, **kw):
            bound = _of.bind(*args, **kw)
            bound.apply_defaults()
            ran[_name] = bound.arguments["generations"]
            return _best

        monkeypatch.setattr(models, name, search)
    queries.model_weights(spark, "")
    queries.model_formula(spark, "")
    assert ran == {"evolve_weights": 100, "evolve_formula": 10}


def test_documents_of_tag_trigrams(spark):
    from stemmata.operators import corpus
    from stemmata.plans import queries

    d = spark.createDataFrame([(1, "One two three. One two three."), (2, "One two three."), (3, "word")], "doc_id bigint, text string")
    rows = [tuple(r) for r in corpus.tag_trigram_documents(d).collect()]
    held = {g: {k for t, k, _ in rows if t == g} for g, _, _ in rows}
    counts = {r.trigram: (r.n, r.docs) for r in corpus.tag_trigrams(d).collect()}
    assert counts == {g: (sum(n for t, _, n in rows if t == g), len(k)) for g, k in held.items()}
    assert {1, 2} in held.values() and "corpus_tag_trigram_documents" in queries.QUERIES
