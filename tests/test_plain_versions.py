"""What SQL can't express, against plain versions of it; ranking, searches and sinks on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemmata.functions import cluster as cl
from stemmata.functions import fingerprint as fp
from stemmata.operators import corpus, evaluate, fingerprints, search
from stemmata.sources import files


def test_p_values(spark):
    rows = [(0.0, 5.0), (1.3, 2.7), (-2.5, 30.0), (8.0, 12.5), (0.2, 1.0), (60.0, 3.0), (None, 4.0), (1.0, None)]
    got = [r.p for r in evaluate.with_p_values(spark.createDataFrame(rows, "t double, freedom double").coalesce(1)).collect()]
    for (t, v), p in zip(rows, got):
        if t is None or v is None:
            assert p is None
            continue
        # the density of Student's t, integrated over the tangent of the half circle
        a = np.linspace(0, math.atan(abs(t) / math.sqrt(v)), 200_001)
        density = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * np.cos(a) ** (v - 1)
        assert p == pytest.approx(1 - 2 * np.trapezoid(density, a), abs=1e-8)


def test_same_document(spark):
    rng = np.random.default_rng(1)
    rows = [(d, a, "f", float(v)) for d in range(3) for a, v in enumerate(rng.normal(size=12))] + [(9, 0, "f", 1.0)]
    long = spark.createDataFrame(rows, "doc_id bigint, atom_num int, feature string, value double")
    got = {r.doc_id: (r.t, r.freedom) for r in evaluate.same_document(long).collect()}
    low = {(r.doc_id, r.atom_num) for r in long.where(corpus.draw(1, "doc_id", "atom_num") < 0.5).collect()}
    for d in range(3):
        a, b = ([v for e, k, _, v in rows if e == d and ((e, k) in low) == side] for side in (True, False))
        va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
        assert got[d] == pytest.approx(((np.mean(a) - np.mean(b)) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))))
    assert got[9] == (None, None)


def test_ranked(spark):
    rng = np.random.default_rng(2)
    ids = rng.permutation(5000).tolist()
    d = spark.createDataFrame([(i, i % 7 if i % 3 else None) for i in ids], "doc_id bigint, w int").repartition(13)
    rows = corpus.ranked(d, ["doc_id"], "w").collect()
    assert sorted((r.doc_id, r["rank"]) for r in rows) == [(i, i + 1) for i in range(5000)]
    sums = np.cumsum([i % 7 if i % 3 else 0 for i in range(5000)])
    assert all(r.run == sums[r.doc_id] for r in rows)
    assert corpus.ranked(d.limit(0), ["doc_id"]).count() == 0
    split = corpus.exact_split(d.select("doc_id"), 0.3)
    assert split.where("part = 'training'").count() == 1500
    top = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9)], "trigram string, n int")
    assert [corpus.ith_most_common(top, i).first().trigram for i in (1, 2, 3)] == ["c", "a", "b"] and corpus.ith_most_common(top, 4).count() == 0


def test_occurrences_of_short_passages(spark):
    """Short and long passages, one automaton for each few of them: all places, as looking at every place finds them."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \U0001f600"), 60)) for _ in range(30)] + ["a" * 40, "", "  "]
    long = "a passage that is long enough to have several fingerprints of its own, wherever it stands"
    texts += [f"x {long} y {long}", long[:-1]]
    passages = [(0, "ab"), (1, "a"), (2, "ab"), (3, ""), (4, None), (5, "\U0001f600 "), (6, long), (7, "aaaa"), (8, "zz")]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, "ab"), (99, None)], "doc_id bigint, text string")
    p = spark.createDataFrame(passages, "item_id bigint, text string")
    want = sorted((k, i, at, at + len(q)) for k, t in enumerate(texts) for i, q in passages if q for at in range(len(t)) if t.startswith(q, at))
    for chars in (3, 1 << 20):
        assert sorted(tuple(r) for r in search.occurrences(d, p, block_chars=chars).collect()) == want


def test_two_level_is_a_search_within_the_chosen(spark):
    rng = np.random.default_rng(4)
    rows = lambda n, atoms: [(d, a, int(h)) for d in range(n) for a in range(atoms) for h in set(rng.integers(0, 40, 6).tolist())]
    schema = "doc_id bigint, atom_num int, hash_value bigint"
    sus, src = rows(12, 3), rows(9, 2)
    whole = lambda rs: sorted({(d, 0, h) for d, _, h in rs})
    make = lambda rs: spark.createDataFrame(rs, schema)
    got = {(r.doc_id, r.atom_num): (r.source_id, r.source_atom, r.confidence) for r in search.two_level(make(whole(sus)), make(whole(src)), make(sus), make(src), search_n=2).collect()}
    sets = lambda rs: {k: {h for d, a, h in rs if (d, a) == k} for k in {(d, a) for d, a, _ in rs}}
    shared = lambda a, b: len((a & b) - {0}) + (0 in a and 0 in b)
    ws, wr, ps, pr = sets(whole(sus)), sets(whole(src)), sets(sus), sets(src)
    for (d, a), own in ps.items():
        level1 = sorted((-shared(ws[d, 0], s) / len(ws[d, 0]), r) for (r, _), s in wr.items() if (ws[d, 0] & s) - {0})[:2]
        best = sorted((-shared(own, s) / len(own), r, b) for (r, b), s in pr.items() if r in {x for _, x in level1} and (own & s) - {0})
        assert got[d, a] == ((best[0][1], best[0][2], pytest.approx(-best[0][0])) if best else (None, None, 0.0))


def test_index_is_read_by_bucket(spark, tmp_path):
    d = spark.createDataFrame([(k, f"document number {k} with some words of its own {k * k}") for k in range(20)], "doc_id bigint, text string")
    h = fingerprints.fingerprints(d, "winnow-k", 8, 13, span=fp.WIDE)
    at = str(tmp_path / "index")
    search.write_index(h.where("doc_id < 12"), at, "winnow-k", True)
    search.write_index(h, at, "winnow-k", True)
    search.write_index(h.where("doc_id < 3"), at, "full", False)
    index = search.read_index(spark, at, "winnow-k", True)
    assert sorted(tuple(r) for r in index.select("doc_id", "atom_num", "hash_value").collect()) == sorted(tuple(r) for r in h.collect())
    asked = h.where("doc_id = 5").select("hash_value")
    want = h.join(asked.distinct(), "hash_value", "left_semi").count()
    assert search.lookup(index, asked).count() == search.lookup(h, asked).count() == want
    few = spark.createDataFrame([(5,), (7,)], "doc_id bigint")
    assert {r.doc_id for r in search.read_index(spark, at, "winnow-k", True, few).collect()} == {5, 7}
    assert search.read_index(spark, at, "full", False).select("doc_id").distinct().count() == 3


def test_clouds_trials_and_upsert(spark, tmp_path):
    c = corpus.gaussian_clouds(spark, 400, 100, 2.0, 0.5, 2, 3)
    s = {(r.feature, r.actual): (r.n, r.m, r.sd) for r in c.groupBy("feature", "actual").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev("value").alias("sd")).collect()}
    assert {k: v[0] for k, v in s.items()} == {(f, a): 300 if a else 1200 for f in ("d0", "d1") for a in (0, 1)}
    assert all(abs(m - 2 * a) < 0.1 and abs(sd - 0.5) < 0.07 for (_, a), (_, m, sd) in s.items())
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, corpus.gaussian_clouds(spark, 400, 100, 2.0, 0.5, 2, 3).repartition(5).collect()))
    at = str(tmp_path / "trials")
    for k in (2, 3):
        files.append_trial(spark, at, corpus="training", features=["a", "b"], k=k, auc=0.5 + k / 100)
    rows = spark.read.parquet(at).collect()
    assert sorted((r.k, r.auc, r.atom_type) for r in rows) == [(2, 0.52, None), (3, 0.53, None)] and all(r.timestamp for r in rows)
    with pytest.raises(ValueError):
        files.append_trial(spark, at, colour="red")
    assert files.feature_sets(["a", "b", "c"], [2, 3]) == [["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
    there, new = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2, "z"), (2, "y"), (1, "w"), (3, None)], "id int, v string")
    assert sorted(map(tuple, files.upsert(new, there, ["id"]).collect())) == [(1, "x"), (2, "y"), (3, None)]


def test_overlaps(spark):
    one = lambda rows: spark.createDataFrame(rows, "doc_id bigint, start int, end int")
    got = sorted(tuple(r) for r in evaluate.overlap_rows(one([(1, 22, 34), (1, 45, 55), (2, 0, 9)]), one([(1, 10, 21), (1, 32, 40), (1, 51, 57)])).collect())
    assert got == [(1, "detected", 22, 34, 2), (1, "detected", 45, 55, 4), (1, "true", 10, 21, 0), (1, "true", 32, 40, 2), (1, "true", 51, 57, 4), (2, "detected", 0, 9, 0)]


@pytest.mark.parametrize("k", [2, 3])
def test_kmeans_is_stable(k):
    """No passage is nearer to another centre, and each centre is the mean (or median) of its own."""
    x = np.random.default_rng(5).normal(size=(60, 3)) + np.repeat(np.eye(3) * 6, 20, 0)
    for method, centre in ((cl.kmeans, np.mean), (cl.kmedians, np.median)):
        c, of = method(x, k)
        power = 2 if method is cl.kmeans else 1
        d = (np.abs(x[:, None] - c[None]) ** power).sum(axis=2)
        assert (d[np.arange(60), of] <= d.min(axis=1) + 1e-9).all()
        assert all(np.allclose(c[j], centre(x[of == j], axis=0)) for j in range(k) if (of == j).any())
    scores = cl.score_kmeans(x, 3)
    assert len(scores) == 60 and (scores[cl.kmeans(cl.whiten(x), 3)[1] == cl._by_size(cl.kmeans(cl.whiten(x), 3)[1])[0]] == 0).all()


@pytest.mark.parametrize("k", [2, 3, 4])
def test_single_linkage(k):
    """Merging the nearest two groups until k are left."""
    x = np.random.default_rng(k).normal(size=(25, 2)) + np.repeat([[0, 0], [9, 0], [0, 9], [30, 30], [4, 4]], [10, 6, 4, 3, 2], 0)
    groups = [{i} for i in range(25)]
    while len(groups) > k:
        d, a, b = min((min(np.linalg.norm(x[i] - x[j]) for i in g for j in h), m, n) for m, g in enumerate(groups) for n, h in enumerate(groups) if m < n)
        groups[a] |= groups.pop(b)
    smallest = min(len(g) for g in groups)
    got = set(np.flatnonzero(cl.score_agglom(x, k) == 1).tolist())
    assert got in [g for g in groups if len(g) == smallest]
