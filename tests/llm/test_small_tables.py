"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemmata.llm import ann, byte_bpe, chat_format, decontam, licenses, near_dup, quality, secrets, toxicity, url_lists

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _rank int, item_id bigint, item_tokens string, label array<int>, p double, start string"
LONG = "word soup with many different things " * 40_000
PROSE = "the quick brown fox jumps over a lazy dog near the river bank while seven small birds watch from old trees"


def rows(texts):
    return [(k, t, None, "s", None if t is None else len(t), k, k, None, [k], None, "x") for k, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "   \n\t"), (None, PROSE), (None, None), (6, LONG), (7, "!?"), (8, "!?"), (9, "x"), (10, "\x00 a퟿\U0001f600 é"), (6, "another text of the same document")]
    return spark.createDataFrame(rows(texts), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "clash"), (2, 0, None, None), (None, 1, 1, ""), (4, None, 1, ""), (1, 1, 0, "again"), (99, 0, 1, "")], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE, "x"), (1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (None, PROSE, "x"), (4, "...", "x"), (5, "x", "x")], "item_id bigint, text string, doc_id string")


def test_quality(odd, none, labels):
    got = quality.classify(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.quality_score)
    assert len(by[2]) == 1 and by[3] == by[4]  # repeated rows alike; null as empty
    assert quality.classify(none, quality.train(none, labels.limit(0))).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema and quality.keep_good(none, labels).count() == 0
    # with no label all documents are good
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def test_near_dup(odd, none):
    got = {(r.doc_id, r.keep_id, r.links, r.copies, r.jaccard) for r in near_dup.near_duplicates(odd).collect()}
    assert got == {(1, 1, 0, 1, 1.0), (2, 1, 0, 1, 1.0), (7, 7, 0, 1, 1.0), (8, 7, 0, 1, 1.0)}
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 6, 7, 9, 10]
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.drop_near_duplicates(none).count() == 0


def test_near_dup_of_repeated_ids(spark):
    def words(k, n=60):
        return " ".join(f"w{k}x{j}" for j in range(n))

    near = lambda k: words(k) + " and more"
    # rows with one id are documents of their own where their sets differ, blank ones are in no class
    texts = [(1, words(1)), (5, words(1)), (5, words(2)), (7, near(2)), (6, "  "), (6, words(3)), (6, words(4)), (8, near(4)), (9, words(3)), (2, words(4)), (10, words(5)), (10, near(5)), (11, words(6)), (11, words(6).upper()), (11, words(6))]
    for order in (texts, texts[::-1]):
        got = sorted((r.doc_id, r.keep_id, r.links, r.copies) for r in near_dup.near_duplicates(spark.createDataFrame(rows(order), DOCS)).collect())
        assert got == [(1, 1, 0, 1), (2, 2, 1, 1), (5, 1, 0, 1), (5, 5, 1, 0), (6, 2, 1, 1), (6, 6, 0, 1), (7, 5, 1, 0), (8, 2, 1, 0), (9, 6, 0, 1), (10, 10, 1, 0), (10, 10, 1, 0)]
        kept = near_dup.drop_near_duplicates(spark.createDataFrame(rows(order), DOCS)).collect()
        assert sorted(r.doc_id for r in kept) == [1, 2, 5, 6, 6, 10, 11]
        assert {r.text for r in kept if r.doc_id == 5} == {words(2)} and {r.text for r in kept if r.doc_id == 6} == {"  ", words(3)}


def test_decontam(odd, none, items):
    got = sorted((r.item_id, r.doc_id, r.kind) for r in decontam.find_leaks(odd, items).collect())
    assert got == [(1, 1, "phrase"), (1, 2, "phrase"), (5, 9, "phrase")]
    kept = decontam.drop_leaks(odd, items)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 6, 7, 8, 10]
    assert decontam.find_leaks(none, items).count() == 0 and decontam.find_leaks(odd, items.limit(0)).count() == 0
    assert decontam.drop_leaks(odd, items.limit(0)).count() == odd.count()


def test_secrets(spark, odd, none):
    assert secrets.find_secrets(odd).count() == 0 and secrets.find_secrets(none).count() == 0
    key = "AKIA" + "Q" * 16
    d = spark.createDataFrame(rows([(1, f"a {key} b {key}"), (1, f"a {key} b {key}"), (None, key), (2, LONG + key)]), DOCS)
    assert secrets.find_secrets(d).count() == 6
    red = secrets.redact_secrets(d)
    assert red.schema == d.schema
    assert [(r.text[-30:], r.n_chars == len(r.text)) for r in red.where("doc_id = 1").collect()] == [("[aws-access-key] b [aws-access-key]"[-30:], True)] * 2
    assert secrets.redact_secrets(odd).count() == odd.count() and secrets.redact_secrets(none).count() == 0


def test_byte_bpe(odd, none):
    enc = byte_bpe.encode(odd)
    assert enc.count() == odd.count() and enc.where("NOT round_trip").count() == 0
    back = {(r.doc_id, r.text) for r in byte_bpe.decode(enc).collect()}
    assert back == {(r.doc_id, r.text) for r in odd.collect()}
    assert enc.where("doc_id = 3").first().token_ids is None and enc.where("doc_id = 4").first().token_ids == []
    assert byte_bpe.encode(none).count() == 0


def test_toxicity(odd, none, labels):
    got = toxicity.classify(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert all(r.toxicity < 1e-9 for r in got if r.doc_id in (3, 4, 5, 7))
    assert toxicity.classify(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_licenses(spark, odd, none):
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0
    d = spark.createDataFrame(rows([(1, "First line.\nReleased under the MIT License.\n\nend"), (1, "First line.\nReleased under the MIT License.\n\nend"), (None, "SPDX-License-Identifier: Apache-2.0"), (2, LONG + "\nLicensed under CC BY-NC 4.0.")]), DOCS)
    got = sorted(((r.doc_id or 0), r.paragraph, r.start, r.end, r.family, r.confirmed) for r in licenses.scan(d).collect())
    n = len(LONG) + 1
    assert got == [(0, 0, 0, 35, "apache", True), (1, 1, 12, 43, "mit", True), (1, 1, 12, 43, "mit", True), (2, 1, n, n + 28, "cc-by-nc", True)]


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, prompt string, at int"
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 2, None, "x"), (1, 3, " Assistant ", ""), (1, 4, "assistant", "<|im_end|>"), (None, 0, "assistant", "a"), (2, None, "assistant", "a"), (3, 0, "assistant", None), (4, 0, "assistant", "first")]
    got = sorted(chat_format.expand(spark.createDataFrame([(*r, "p", 1) for r in c], schema)).collect())
    assert [(r.conv_id, r.turn, r.n_context) for r in got] == [(1, 1, 1), (1, 4, 4), (4, 0, 0)]
    assert got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and got[0].completion == "yo<|im_end|>"
    assert got[1].completion == "< |im_end|><|im_end|>"
    whole = got[0].prompt + got[0].completion
    assert whole[got[0].train_start : got[0].train_end] == got[0].completion
    assert chat_format.expand(spark.createDataFrame([], schema)).count() == 0
    many = spark.createDataFrame([(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 500, "p", 1) for k in range(200)], schema)
    last = {r.turn: r for r in chat_format.expand(many).collect()}
    assert sorted(last) == list(range(1, 200, 2)) and last[199].n_context == 199 and all(f"turn {k} " in last[199].prompt for k in range(199))


def test_url_lists(spark):
    from datetime import datetime as D

    e = [("block", "Bad.example/", "add", D(2024, 1, 1)), ("block", "bad.example", "remove", D(2024, 2, 1)), ("allow", "bad.example/ok", "add", D(2024, 1, 10)), ("block", "x.example", "add", D(2024, 1, 1)), ("block", "x.example", "remove", D(2024, 1, 1)), (None, "y", "add", D(2024, 1, 1)), ("block", None, "add", None), ("block", "z.example", "other", D(2024, 1, 1)), ("block", "t.example", "add", D(2024, 1, 1)), ("allow", "t.example", "add", D(2024, 1, 1)), ("block", "[2001:db8::1]/x", "add", D(2024, 1, 1))]
    entries = spark.createDataFrame(e, "list string, pattern string, action string, at timestamp").withColumn("host", F.lit(1))
    c = [(1, "http://a.bad.example/q", D(2024, 1, 1)), (2, "http://bad.example./ok/deep?x=1", D(2024, 1, 15)), (3, "https://u:p@BAD.example:80/okay", D(2024, 1, 31, 23)), (4, "http://bad.example", D(2024, 2, 1)), (5, "http://x.example", D(2024, 3, 1)), (6, None, D(2024, 1, 1)), (7, "http://bad.example", None), (8, "not a url", D(2024, 1, 1)), (9, "http://t.example", D(2024, 1, 2)), (1, "http://a.bad.example/q", D(2024, 1, 1)), (None, "http://notbad.example", D(2024, 1, 5)), (10, "http://u@[2001:DB8::1]:8080/x", D(2024, 1, 2)), (11, "http://" + "a." * 300 + "bad.example/" + "p/" * 300, D(2024, 1, 2))]
    captures = spark.createDataFrame(c, "page_id bigint, url string, fetched_at timestamp").withColumn("key", F.lit("k")).withColumn("list", F.lit("l"))
    got = sorted(((r.page_id or 0), r.decision, r.pattern) for r in url_lists.as_of(captures, entries).collect())
    want = [(0, "none", None), (1, "block", "bad.example"), (1, "block", "bad.example"), (2, "allow", "bad.example/ok"), (3, "block", "bad.example"), (4, "none", None), (5, "none", None), (6, "none", None), (7, "none", None), (8, "none", None), (9, "allow", "t.example"), (10, "block", "[2001:db8::1]/x"), (11, "block", "bad.example")]
    assert got == want
    assert url_lists.as_of(captures.limit(0), entries).count() == 0
    assert {r.decision for r in url_lists.as_of(captures, entries.limit(0)).collect()} == {"none"}


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1.0, 0.0]), (1, [5.0, 5.0])]
    d = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").withColumn("uid", F.lit("u")).withColumn("ids", F.lit(1))
    def found(condition, **how):
        got = {}
        for r in ann.neighbours(d, condition, **how).orderBy("vec_id", "rank").collect():
            got.setdefault(r.vec_id, []).append((r.neighbour_id, r.similarity))
        return got

    h = round(2**-0.5, 6)
    want = {1: [(2, 1.0), (12, 1.0)], 2: [(1, 1.0), (12, 1.0)], 12: [(1, 1.0), (2, 1.0)], 3: [(1, h), (2, h)], 11: [(3, -h), (1, -1.0)]}
    assert found(F.lit(True), k=2) == want
    assert found(F.col("vec_id") % 3 == 0, k=2) == {k: v for k, v in want.items() if k % 3 == 0}
    assert found(None) == {} and found(F.col("vec_id") == 4) == {}  # no id is divisible by 100; one without a direction doesn't ask
    assert ann.neighbours(d.limit(0)).count() == 0


def test_stages(spark, odd, none, tmp_path, labels, items):
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    items.write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd, none):
        at = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.schema == docs.schema
            assert out.count() <= at.count()
            at = out
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
