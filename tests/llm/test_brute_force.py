"""The operators that SQL can't express, against plain versions of themselves, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import io
import os
import re
import tarfile
import textwrap
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from stemmata.llm import ann, byte_bpe, decontam, gbt, licenses, near_dup, quality, registry, secrets, toxicity


@pytest.fixture(scope="module")
def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def items(sf):
    return pq.read_table(f"{sf}/benchmark.parquet").to_pylist()


WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")


def tokens(text):
    return [w.lower() for w in WORD.findall(text or "")]


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def groups(rows):
    """doc_id to the smallest of its group, by all pairs."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= 0.5 * max(len(x), len(y)) and len(x & y) >= 0.5 * len(x | y):
            pairs.append((a, b))
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return pairs, {d: find(d) for d in sets}


def test_near_duplicates(spark, sf, documents):
    rows = registry.QUERIES["op5_minhash_dedup"](spark, sf).collect()
    got = {r.doc_id: r.keep_id for r in rows}
    pairs, root = groups(documents)
    together = [got.get(a, a) == got.get(b, b) for a, b in pairs]
    assert len(pairs) > 10 and np.mean(together) >= 0.95
    assert all(root[d] == root[k] for d, k in got.items())  # nothing is joined that isn't alike
    assert len(rows) == len(got) and all(k == min(d for d in got if got[d] == k) for k in got.values())
    check_links(rows, documents, pairs)


def check_links(rows, documents, pairs, least=0.95):
    """Links and copies against all pairs: every document's, of different sets once each."""
    sets = {r["doc_id"]: frozenset(shingles(r["text"])) for r in documents}
    links, copies, top = {}, {}, {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            top[x] = max(top.get(x, 0), len(sets[a] & sets[b]) / len(sets[a] | sets[b]))
            if sets[a] == sets[b]:
                copies[x] = copies.get(x, 0) + 1
            else:
                links.setdefault(x, set()).add(sets[y])
    assert all(r.copies == copies.get(r.doc_id, 0) and r.links <= len(links.get(r.doc_id, ())) for r in rows)
    assert all(r.jaccard <= top[r.doc_id] + 1e-9 for r in rows)
    assert sum(r.links for r in rows) >= least * sum(len(v) for v in links.values())


def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch):
    """Many different texts that share a passage, of which some are alike: cut into blocks, every link is found once."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    passage = words(120)
    texts = [passage + " " + words(int(rng.integers(1, 12))) for _ in range(120)]  # all alike
    texts += [passage + " " + words(260) for _ in range(120)]  # share the passage, aren't alike
    documents = [{"doc_id": k, "text": t} for k, t in enumerate(texts)]
    monkeypatch.setattr(near_dup, "PART", 16)
    rows = near_dup.near_duplicates(spark.createDataFrame(documents, "doc_id bigint, text string")).collect()
    pairs, root = groups(documents)
    assert {r.doc_id: r.keep_id for r in rows} == {d: r for d, r in root.items() if d < 120} and len(pairs) == 120 * 119 // 2
    assert {r.links for r in rows} == {119}
    check_links(rows, documents, pairs, 1.0)


def leaks(documents, items, phrase=decontam.PHRASE, ratio=decontam.RATIO, slack=decontam.SLACK):
    """(item, document) to phrase or proximity, by looking at every place."""
    out = {}
    for i in items:
        t = tokens(i["text"])
        n, least = min(phrase, len(t)), int(np.ceil(ratio * len(t) - 1e-9))
        if not t:
            continue
        for d in documents:
            w = tokens(d["text"])
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if any(tuple(t[k : k + n]) in grams for k in range(len(t) - n + 1)):
                out[i["item_id"], d["doc_id"]] = "phrase"
                continue
            places = {}
            for k, x in enumerate(w):
                places.setdefault(x, []).append(k)
            starts = {}
            for o, x in enumerate(t):
                for s in {p - o + j for p in places.get(x, []) for j in range(-slack, slack + 1)}:
                    starts[s] = starts.get(s, 0) + 1
            if max(starts.values(), default=0) >= least:
                out[i["item_id"], d["doc_id"]] = "proximity"
    return out


def test_decontamination(spark, sf, documents, items):
    got = {(r.item_id, r.doc_id): r.kind for r in registry.QUERIES["op9_decontamination"](spark, sf).collect()}
    assert got == leaks(documents, items)
    # planted: words swapped in and out of a passage, a passage broken off, one of other words
    rng, t = np.random.default_rng(3), tokens(items[0]["text"])
    docs = []
    for k in range(40):
        w = list(t)
        for _ in range(rng.integers(0, len(w) // 2)):
            w[rng.integers(len(w))] = f"zz{rng.integers(50)}"
        if k % 3 == 0:
            w.insert(int(rng.integers(len(w))), "qq")
        docs.append({"doc_id": k, "text": " ".join(["pre"] * int(rng.integers(0, 30)) + w + ["post"] * int(rng.integers(0, 30)))})
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items[:3], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id): r.kind for r in decontam.find_leaks(d, b).collect()}
    want = leaks(docs, items[:3])
    assert got == want and {"phrase", "proximity"} <= set(want.values()) and len(want) < 40


KEY = "AKIA" + "ABCDEFGH01234567"


def test_secrets_in_layers():
    url = lambda s: "".join(f"%{b:02X}" for b in s.encode())
    uni = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)
    b64 = lambda b: base64.b64encode(b if isinstance(b, bytes) else b.encode()).decode()
    plain = f"key {KEY} end"
    layers = {"": plain, "url": url(plain), "unicode": uni(plain), "base64": b64(plain), "base64>gzip": b64(gzip.compress(plain.encode())), "base64>zlib": b64(zlib.compress(plain.encode() * 9)), "url>base64": url(b64(plain)), "unicode>url>base64": uni(url(b64(plain))), "base64>base64": b64("x " + b64(plain) + " y")}
    for path, coded in layers.items():
        text = f"before é {coded} after"
        found = [f for f in secrets.scan_text(text) if f.rule == "aws-access-key"]
        assert found and found[0].path == path and found[0].secret == KEY, path
        a, b = found[0].start, found[0].end
        assert text[a:b] in coded and KEY not in secrets.redact(text, found) and secrets.scan_text(secrets.redact(text, found)) == []
    circle = "%2541%25" * 50 + b64("%41" * 40)
    assert secrets.scan_text(circle) == []  # ends
    folded = base64.encodebytes(gzip.compress((KEY + " " + "".join(map(chr, np.random.default_rng(0).integers(97, 122, 400)))).encode())).decode()
    assert any(f.secret == KEY for f in secrets.scan_text(folded))


def opened(piece):
    """What a base64 piece says, decoded as far as it goes."""
    raw = base64.b64decode(piece + "=" * (-len(piece) % 4))
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def test_secrets_at_every_place(spark):
    plain = f"key {KEY} end"
    for coded in (base64.b64encode(plain.encode()).decode(), base64.b64encode(gzip.compress(plain.encode())).decode(), base64.b64encode(base64.b64encode(plain.encode())).decode()):
        text = f"a: {coded}\nb: {coded}\nc: %41 {coded} {KEY}"
        found = [f for f in secrets.scan_text(text) if f.rule == "aws-access-key"]
        assert len(found) == 4 and {f.secret for f in found} == {KEY} and text[found[3].start : found[3].end] == KEY
        for f, m in zip(found, re.finditer(re.escape(coded.rstrip("=")), text)):
            assert m.start() <= f.start < f.end <= m.end() + 2
            inner = opened(text[f.start : f.end])
            assert any(KEY.encode() in x for x in ([inner] if f.path != "base64>base64" else [opened(inner.decode()[k:][: (len(inner) - k) // 4 * 4]) for k in range(4)]))
        d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        assert secrets.find_secrets(d).where("rule = 'aws-access-key'").count() == 4
        clean = secrets.redact_secrets(d).first().text
        assert secrets.scan_text(clean) == []
    url = base64.b64encode(b"xy " + plain.encode()).decode().replace("=", "%3D")
    assert "%3D" in url and len(secrets.scan_text(url)) == 1  # a run and the same run with its padding unescaped are one place


def test_secrets_of_one_run(spark):
    values = [f"abcdefgh{k:08d}" for k in range(10)]
    config = "\n".join(f"token_{k}: x\ntoken = {v}" for k, v in enumerate(values))
    for raw, packed in ((config.encode(), False), (gzip.compress(config.encode()), True), (base64.b64encode(config.encode()), False)):
        text = f"config {base64.b64encode(raw).decode()} end"
        found = secrets.scan_text(text)
        assert sorted(f.secret for f in found if f.rule == "assigned-secret") == values
        assert len({(f.start, f.end) for f in found}) == (1 if packed else 10)
        assert secrets.scan_text(secrets.redact(text, found)) == [] and (not packed or secrets.redact(text, found) == "config [assigned-secret] end")
        rows = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
        assert len({r.secret_sha256 for r in rows}) == len(rows) == 10


def test_secrets_planted_in_every_coding(spark):
    """What is planted is known: each secret must be found at its place and nothing else, and its neighbours must stay."""
    rng = np.random.default_rng(8)
    b64 = lambda b: base64.b64encode(b).decode()
    coders = [
        lambda s: s,
        lambda s: "".join(f"%{c:02X}" for c in s.encode()),
        lambda s: "%FF%FE" + "".join(f"%{c:02x}" for c in s.encode()) + "%80",
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: b64(s.encode()),
        lambda s: "/path/" + b64(s.encode()),
        lambda s: "x" + b64(s.encode()),
        lambda s: "xy" + b64(s.encode()).rstrip("=") + "A",
        lambda s: b64(s.encode("utf-16-le")),
        lambda s: b64(b"\xff\xfe" + s.encode("utf-16-be")),
        lambda s: b64(b"\x00\x01\xff" + s.encode() + b"\xfe"),
        lambda s: b64(zlib.compress(s.encode())),
        lambda s: b64(b64(gzip.compress(s.encode())).encode()),
        lambda s: "".join(f"%{c:02X}" for c in b64(s.encode()).encode()),
        lambda s: s.encode("utf-16-le").decode("latin-1"),
    ]
    rows, want = [], []
    for k in range(120):
        secret = "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
        coded = coders[k % len(coders)](f"left-{'l' * (k % 4)} {secret} right")
        pre = "some words é \U0001f600 before; " * int(rng.integers(0, 3))
        rows.append((k, f"{pre}<{coded}> after {k}"))
        want.append((k, "aws-access-key", secret, len(pre) + 1, len(pre) + 1 + len(coded)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.rule, r.secret_sha256, r.start, r.end) for r in secrets.find_secrets(d).collect())
    assert [g[:3] for g in got] == [(k, rule, hashlib.sha256(s.encode()).hexdigest()) for k, rule, s, _, _ in want]
    assert all(w[3] <= g[3] < g[4] <= w[4] for g, w in zip(got, want))
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(d).collect()}
    for (k, text), g in zip(rows, got):
        assert clean[k] == text[: g[3]] + "[aws-access-key]" + text[g[4] :] and secrets.scan_text(clean[k]) == []
    # of plain base64 only the groups that hold the key go: its neighbours can still be read
    assert all(opened(rows[k][1].split("<")[1].split(">")[0][: got[k][3] - rows[k][1].index("<") - 1]).startswith(b"left-") for k in range(4, 120, len(coders)))


def test_suspects_hold_all_that_is_found(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    fold = lambda s, n: "\n".join(s[k : k + n] for k in range(0, len(s), n))
    plain = [KEY, "ghp_" + "a1" * 18, "github_pat_" + "a1" * 11, "xoxb-1234567890", "AIza" + "a1b2c" * 7, "sk_live_" + "a1" * 8, "eyJ" + "a1" * 4 + ".eyJ" + "a1" * 4 + "." + "a1" * 8]
    plain += ["-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----", "ftp://bob:pw1@db1", 'passwd="abcdefghijk1"', "CREDENTIAL => abcdefghijklmno1", "to\u212aen = abcdefghijklmno1"]
    coders = [lambda s: s, lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: b64(s.encode()), lambda s: b64(gzip.compress(s.encode())), lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s)]
    coders += [lambda s, f=f: "".join(f.format(ord(c)) for c in s) for f in ("\\u{:04x}", "\\U{:08x}")]
    coders += [lambda s, n=n: fold(b64(s.encode()), n) for n in (20, 21, 22, 23, 24, 76)]
    texts = [code(s) for s in plain for code in coders]
    binary = [b"\0name\0" + f"{KEY}\f\x1b".encode(), b"\xff\xfe caf\xe9 " + KEY.encode() + b" \x80"]
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as f:
        info = tarfile.TarInfo("a.cfg")
        info.size = len(KEY)
        f.addfile(info, io.BytesIO(KEY.encode()))
    must = [b64(raw) for raw in (*binary, *map(gzip.compress, binary), gzip.compress(tar.getvalue()))]
    assert all(KEY in {f.secret for f in secrets.scan_text(t)} for t in must)
    must += ["".join(f"\\U{ord(c):08X}" for c in KEY), b64(b"ftp://bob:pw1@db1"), fold(b64(b"key " + KEY.encode() + b" end and more"), 20)]
    found = [bool(secrets.scan_text(t)) for t in texts + must]
    chosen = set(secrets._suspects(pa.array(texts + must)))
    assert all(found) and chosen == set(range(len(found)))
    d = spark.createDataFrame([(k, t) for k, t in enumerate(must)], "doc_id bigint, text string")
    assert secrets.find_secrets(d).select("doc_id").distinct().count() == len(must)


def test_secrets_of_a_table(spark, sf, documents):
    got = sorted((r.doc_id, r.rule, r.start, r.end) for r in registry.QUERIES["op2_secret_scan"](spark, sf).collect())
    assert got == sorted((d["doc_id"], f.rule, f.start, f.end) for d in documents for f in secrets.scan_text(d["text"]))


def test_byte_bpe(spark, sf, documents):
    ranks = byte_bpe.read_ranks(byte_bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.token_ids for r in registry.QUERIES["op3_byte_bpe"](spark, sf).collect()}
    assert got == {d["doc_id"]: own.encode_ordinary(d["text"]) for d in documents}
    c, rng = byte_bpe.Codec(ranks), np.random.default_rng(1)
    texts = ["".join(chr(x) for x in rng.choice([*range(1, 600), 0x2028, 0x3042, 0x1F600, 0xE000], 80)) for _ in range(50)] + ["a" * 5000, " \n \t ", "▁_ don't  x"]
    for t, raw in zip(texts, c.encode(texts)):
        ids = np.frombuffer(raw, np.int32)
        assert ids.tolist() == own.encode_ordinary(t) and c.decode(ids).decode() == t


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.fit(x[:1000], y[:1000])
    assert ((m.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95

    assert np.allclose(m.raw(x[:50]), [walk(m, r) for r in x[:50]])


def walk(m, row):
    total = m.base
    for node in m.roots:
        while m.left[node] != node:
            node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
        total += m.value[node]
    return total


@pytest.fixture(scope="module")
def labelled():
    """Held-out accuracy needs more labels than the smallest tables have."""
    sf = os.environ.get("TEST_LABELLED_DIR", "/root/testdata/sf0.01")
    d = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    return [(d[r["doc_id"]], r["quality"], r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in d]


def test_quality_held_out(labelled):
    x = quality.statistics(pa.array([t for t, _, _ in labelled]))
    y = np.array([q for _, q, _ in labelled], float)
    held = np.arange(len(y)) % 4 == 0
    good = gbt.fit(x[~held], y[~held]).probability(x[held]) >= quality.THRESHOLD
    assert (good == y[held]).mean() > 0.95 and good[y[held] == 1].mean() > 0.97 and (~good)[y[held] == 0].mean() > 0.6


def plain_statistics(text):
    w = WORD.findall(text)
    pairs, raw = list(zip(w, w[1:])), text.encode()
    n, size = max(1, len(w)), max(1, len(raw))
    share = lambda chars: sum(b in chars for b in raw) / size
    return [
        np.log1p(len(w)), sum(len(x.encode()) for x in w) / n, sum(len(x.encode()) > 12 for x in w) / n, share(range(65, 91)), share(range(48, 58)), share(b"\t\x0b\x0c\r "), share(b"\n"), share(b".,;:'\"()?-"),
        share(b"!#$%&*+/<=>@[\\]^_`{|}~"), share(range(128, 256)), len(set(w)) / n, max((w.count(x) for x in set(w)), default=0) / n, sum(a == b for a, b in pairs) / max(1, len(pairs)), len(set(pairs)) / max(1, len(pairs)),
    ]


def test_quality_of_a_table(spark, sf, documents):
    """Statistics by counting one text at a time, and the query's scores by walking the trees of the same labels."""
    some = [d for d in documents if len(d["text"]) < 6000]
    x = quality.statistics(pa.array([d["text"] for d in some]))
    want = np.array([plain_statistics(d["text"]) for d in some])
    assert np.allclose(x, want)
    rows = {d["doc_id"]: d["text"] for d in documents}
    labels = sorted((r["doc_id"], r["quality"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in rows)
    model = gbt.fit(quality.statistics(pa.array([rows[i] for i, _ in labels])), np.array([q for _, q in labels], float))
    got = {r.doc_id: (r.quality_score, r.is_good) for r in registry.QUERIES["op4_quality_classifier"](spark, sf).collect()}
    assert len(got) == len(rows)
    for d, v in zip(some, want):
        score = 1 / (1 + np.exp(-walk(model, v)))
        assert np.isclose(got[d["doc_id"]][0], score) and got[d["doc_id"]][1] == (score >= quality.THRESHOLD)


def test_statistics_of_many_short_texts(spark):
    d = spark.range(70_000).selectExpr("id AS doc_id", "'a b a c' AS text")
    x = np.concatenate([quality.statistics(c) for _, c in quality._text.chunks(pa.array(["a b a c"] * 70_000))])
    assert len(x) == 70_000 and (x == x[0]).all() and x[0][10] == 0.75 and x[0][11] == 0.5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = quality.classify(d, gbt.fit(np.zeros((0, 14)), np.zeros(0))).agg({"quality_score": "min", "*": "count"}).first()
        assert got[1] == 70_000 or got[0] == 70_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def misspelt(word, rng):
    at = int(rng.integers(1, len(word) - 1))
    return [word[:at] + word[at] + word[at:], word[:at] + word[at + 1 :], word[:at] + "aeioust"[int(rng.integers(7))] + word[at + 1 :]][int(rng.integers(3))]


def plain_toxicity(text, shares, bias):
    """Mean over words of the mean of their subwords' shares; a word's subwords are itself and the 3- to 5-grams of its bytes between two blanks."""
    w = [x.encode() for x in tokens(text)]
    if not w:
        return -np.inf
    per = lambda x: [shares(x, 0), *(shares(x, n, i) for n in (3, 4, 5) for i in range(len(x) + 2 - n + 1))]
    return np.mean([np.mean(per(x)) for x in w]) + bias


def test_toxicity_held_out(labelled):
    texts, y = [t for t, _, _ in labelled], np.array([t for _, _, t in labelled], float)
    held = np.arange(len(y)) % 4 == 0
    m = toxicity.fit([t for t, h in zip(texts, held) if not h], y[~held])
    z = toxicity.log_odds(pa.array([t for t, h in zip(texts, held) if h]), m)
    assert y[held].sum() > 5 and (z >= 0)[y[held] == 1].mean() >= 0.5 and (z < 0)[y[held] == 0].mean() > 0.95
    m = toxicity.fit(texts, y)
    z = toxicity.log_odds(pa.array(texts), m)
    assert (z >= 0)[y == 1].mean() > 0.95 and (z < 0)[y == 0].mean() > 0.99
    # a misspelling that was never seen shares n-grams with its word; an ordinary word doesn't
    base = "the erthand of ention they werand "
    a, b, c = toxicity.log_odds(pa.array([base + "idiot", base + "idiott", base + "olive"]), m)
    assert a > c and b > c


def test_toxicity_of_misspellings():
    """Texts of invented words, half with an insult; held-out texts hold misspellings that no training text has."""
    rng = np.random.default_rng(5)
    insults = ["idiot", "moron", "scumbag", "pathetic", "worthless", "disgusting"]
    syllables = ["ta", "ren", "ol", "mi", "shu", "per", "gan", "lo", "vi", "ster"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))

    def text(insult):
        w = [word() for _ in range(int(rng.integers(15, 60)))]
        if insult:
            w[int(rng.integers(len(w)))] = insult
        return " ".join(w)

    train = [text(str(rng.choice(insults)) if k % 2 else None) for k in range(1200)]
    m = toxicity.fit(train, np.arange(1200) % 2)
    held = [text(misspelt(str(rng.choice(insults)), rng) if k % 2 else None) for k in range(400)]
    z = toxicity.log_odds(pa.array(held), m)
    assert (z >= 0)[1::2].mean() > 0.75 and (z < 0)[::2].mean() > 0.95


def test_toxicity_of_few_labels(spark):
    """No screen empties the vocabulary: with the smallest tables' labels the toxic texts are found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, toxicity.train(docs, labels)).join(labels, "doc_id").groupBy("toxic").agg({"is_toxic": "count_if"}).collect()
    n = {r.toxic: r.n for r in labels.join(docs, "doc_id").groupBy("toxic").agg({"*": "count"}).toDF("toxic", "n").collect()}
    got = {r[0]: r[1] for r in got}
    assert got[1] > 0.9 * n[1] and got[0] < 0.05 * n[0]


def test_toxicity_of_a_table(spark, sf, documents):
    """The query's scores by going through every word's subwords one at a time."""
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(d, labels)
    base = 0x9E3779B97F4A7C15
    value = {}

    def raw_hash(b):  # the polynomial of the byte values, by its definition
        return sum(int(toxicity._text._BYTE[x]) * pow(base, i, 1 << 64) for i, x in enumerate(b)) % (1 << 64)

    def shares(w, n, i=0):
        key = (w, n, i)
        if key not in value:
            h = int(toxicity._text.mix(np.array([raw_hash(w)], np.uint64))[0]) if n == 0 else raw_hash((b" " + w + b" ")[i : i + n])
            value[key] = m.share[(h * (base + 2 * n) % (1 << 64)) >> (64 - toxicity.BITS)]
        return value[key]

    got = {r.doc_id: r for r in registry.QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(got) == len(documents)
    for x in [x for x in documents if len(x["text"]) < 2500]:
        z = plain_toxicity(x["text"], shares, m.bias)
        assert np.isclose(got[x["doc_id"]].toxicity, 1 / (1 + np.exp(-np.clip(z, -50, 50))), atol=1e-4) and got[x["doc_id"]].is_toxic == (got[x["doc_id"]].toxicity >= 0.5)


def plain_paragraphs(text):
    """(start, end): a line of 40 to 120 bytes and five blanks that ends in no mark goes on in the next one with a word."""
    lines, out, at, start = text.split("\n"), [], 0, 0
    for k, line in enumerate(lines):
        end = at + len(line)
        bare = line[:-1] if line.endswith("\r") else line
        on = k + 1 < len(lines) and 40 <= len(bare.encode()) <= 120 and bare[-1] not in ".!?:;" and bare.count(" ") >= 5 and WORD.search(line) and WORD.search(lines[k + 1])
        if not on:
            out.append((start, end))
            start = end + 1
        at = end + 1
    return out


def test_licenses(spark, sf, documents):
    """The table against a plain reading of the same model: n-grams of words looked up one by one."""
    model = licenses.train()
    texts, y = licenses.examples(99, 1500)
    p = model.probabilities(licenses._rows(licenses._features(texts), model.terms) @ model.weights + model.bias)
    best = np.where(p[:, :-1].max(axis=1) >= licenses.THRESHOLD, p[:, :-1].argmax(axis=1), len(model.families))
    assert (best == y).mean() > 0.9
    place = {}
    for t in {t for ts in licenses.TEMPLATES.values() for t in ts}:
        w = tokens(t)
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                h = licenses._grams(licenses._text.words(pa.array([" ".join(w[k : k + n])])).hashes, n)[0]
                place[tuple(w[k : k + n])] = int(np.searchsorted(model.terms, h))
    folded = "\n".join(["x", *textwrap.wrap(licenses.TEMPLATES["mit"][8], 70), "", *("# " + x for x in textwrap.wrap(licenses.TEMPLATES["bsd"][-1], 60)), "Licensed under CC BY 4.0.", "so it goes"])
    more = [{"doc_id": -1, "text": folded}, {"doc_id": -2, "text": folded.replace("\n", "\r\n")}]
    want = []
    for d in documents + more:
        for n, (a, b) in enumerate(plain_paragraphs(d["text"])):
            w = tokens(d["text"][a:b])
            found = {place[g] for k in (1, 2, 3) for i in range(len(w) - k + 1) if (g := tuple(w[i : i + k])) in place}
            q = model.probabilities((model.weights[sorted(found)].sum(axis=0) + model.bias)[None])[0]
            if found and q[:-1].max() >= licenses.THRESHOLD:
                want.append((d["doc_id"], n, a, b, model.families[int(q[:-1].argmax())]))
    docs = spark.createDataFrame(documents + more, "doc_id bigint, text string")
    got = [(r.doc_id, r.paragraph, r.start, r.end, r.family) for r in licenses.scan(docs).collect()]
    assert sorted(got) == sorted(want)
    assert {(i, f) for i, *_, f in got if i < 0} == {(i, f) for i in (-1, -2) for f in ("mit", "bsd", "cc-by")}
    assert sorted(g for g in got if g[0] >= 0) == sorted((r.doc_id, r.paragraph, r.start, r.end, r.family) for r in registry.QUERIES["op10_license_scan"](spark, sf).collect())


def test_licenses_in_other_words():
    """Notices that neither training nor calibration saw: named right or unknown, and the model is about as sure as it is right."""
    notices = {
        "mit": ["We publish our code under the MIT license so anyone may use it.", "to use, copy, modify, merge, publish, distribute, sublicense copies of the Software without restriction", "The above permission notice must be included in all substantial portions of the Software."],
        "apache": ["Our connector is open source under the Apache License 2.0.", "Unless required by law or agreed to in writing, software distributed under this License is on an as is basis."],
        "gpl": ["The driver is released under version 2 of the GNU General Public License.", "This tool is distributed in the hope that it will be useful, but without any warranty.", "It can be redistributed and modified under the terms of the GNU General Public License."],
        "lgpl": ["The client library is released under the GNU Lesser General Public License."],
        "agpl": ["Our hosted application is under the GNU Affero General Public License."],
        "bsd": ["Redistributions of the binary must reproduce the above copyright notice and this list of conditions.", "The port is under a BSD-style license."],
        "mpl": ["Files in this folder are subject to the Mozilla Public License 2.0."],
        "epl": ["The editor is made available under the terms of the Eclipse Public License."],
        "boost": ["The header is distributed under the Boost Software License."],
        "zlib": ["Altered source versions of this codec must be plainly marked and must not be misrepresented as being the original."],
        "cc-by": ["All figures are under a Creative Commons Attribution 4.0 International License."],
        "cc-by-sa": ["Our wiki is under the Creative Commons Attribution-ShareAlike 4.0 license."],
        "cc-by-nc": ["The recordings are under a Creative Commons Attribution-NonCommercial 4.0 license."],
        "public-domain": ["I dedicate this software to the public domain, for any purpose, commercial or non-commercial."],
        "isc": ["Permission to use, copy, modify and distribute this program with or without fee is granted, provided that the above copyright notice appears in all copies."],
        "proprietary": ["This manual is proprietary and confidential; no part of it may be reproduced without written permission."],
        "unknown": ["The dog was licensed by the town and released from the pound.", "Version 2 of the film was shown in public.", "The general gave permission to copy the map.", "Notice: the above rooms are reserved.", "A mozilla of smoke rose over Apache land.", "Warranty work without fee is granted for two years."],
    }
    model = licenses.train()
    pairs = [(f, t) for f, ts in notices.items() for t in ts]
    p = model.probabilities(licenses._rows(licenses._features([t for _, t in pairs]), model.terms) @ model.weights + model.bias)
    named = [([*model.families, "unknown"][int(x.argmax())] if x[:-1].max() >= licenses.THRESHOLD else "unknown") for x in p]
    assert all(n in (f, "unknown") for n, (f, _) in zip(named, pairs))
    right = np.array([n == f for n, (f, _) in zip(named, pairs)])
    assert right.mean() >= 0.8 and abs(p.max(axis=1).mean() - right.mean()) < 0.15
    # every template paragraph by itself is named right and confirmed
    for family, ts in licenses.TEMPLATES.items():
        q = model.probabilities(licenses._rows(licenses._features(ts), model.terms) @ model.weights + model.bias)
        assert (q[:, model.families.index(family)] >= licenses.THRESHOLD).all() and all(licenses.confirm(t, family)[1] >= licenses.CONFIRM for t in ts)


def recall(rows, x, k=10):
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    u, out = ann.unit(x), []
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        out.append(len(found & set(np.argsort(-s, kind="stable")[:k].tolist())) / k)
    return np.mean(out), set(got)


def test_nearest_neighbours(spark, monkeypatch):
    """Recall against brute force: without structure, and with half of all rows in one tight group, whose buckets are cut into blocks."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_ASKS", 10)
    rng = np.random.default_rng(2)
    plain = rng.normal(size=(3000, 20)).astype(np.float32)
    grouped = plain.copy()
    grouped[:1500] = grouped[0] + 0.2 * grouped[:1500]
    for x in (plain, grouped):
        d = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
        found, asked = recall(ann.neighbours(d, k=10, bucket=100).collect(), x)
        assert found >= 0.9 and asked == set(range(0, 3000, 100))


def test_nearest_neighbours_of_the_table(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    found, asked = recall(registry.QUERIES["op8_nearest_neighbours"](spark, sf).collect(), np.array([r["embedding"] for r in rows]))
    assert found >= 0.9 and asked == set(range(0, len(rows), 100))


def test_hadamard():
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def test_pipeline(spark, sf, documents, items):
    """Plain versions of all stages, one after another; the quality model is the operator's own."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, labels)
    p = model.probability(np.concatenate([quality.statistics(pa.array([d["text"]])) for d in documents]))
    rows = [d for d, x in zip(documents, p) if x >= quality.THRESHOLD]
    _, root = groups(rows)
    rows = [d for d in rows if root[d["doc_id"]] == d["doc_id"]]
    hit = {d for _, d in leaks(rows, items)}
    rows = [d for d in rows if d["doc_id"] not in hit]
    own = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})
    want = {d["doc_id"]: own.encode_ordinary(secrets.redact(d["text"], secrets.scan_text(d["text"]))) for d in rows}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
