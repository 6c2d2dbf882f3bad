import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemmata.functions import cluster, fingerprint, network
from stemmata.functions import tokenize as tk


def test_words():
    text = "Nature's end--it came. Slowly, (very) 3.14 'tis e.g. so... well-known"
    assert [text[a:b] for a, b in tk.words(text)] == ["Nature", "'s", "end", "--", "it", "came.", "Slowly", ",", "(", "very", ")", "3.14", "'tis", "e.g.", "so", "...", "well-known"]


def test_sentences_and_pieces():
    text = 'One two. "Three!" Four? 3.5 is five'
    assert [text[a:b] for a, b in tk.sentences(text)] == ["One two.", '"Three!"', "Four?", "3.5 is five"]
    assert tk.nchars("x" * 65, 20) == [(0, 20), (20, 40), (40, 65)]
    assert tk.nchars("x" * 5, 20) == [(0, 5)] and tk.nchars("", 20) == [(0, 0)]
    assert tk.paragraphs("a b\n\n \n c\nd\n\n") == [(0, 3), (8, 11)]
    assert tk.paragraphs("\n\na") == [(0, 0), (2, 3)]
    assert tk.lines(" a\n\nb \n") == [(0, 2), (4, 5)]
    with pytest.raises(ValueError):
        tk.tokenize("x", "verse")


@given(st.text(alphabet="ab.,-' \n\t\"!?(é", max_size=60))
def test_tokens_tile(text):
    spans = tk.words(text)
    assert "".join(text[a:b] for a, b in spans) == "".join(c for c in text if c not in " \t\n\f\r")
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert all(text[a:b].strip(" \t\n\f\r") == text[a:b] for a, b in tk.sentences(text))


def test_strip_punctuation():
    assert tk.strip_punctuation(["a.", ",", "...", "()", "it's", ""]) == ["a", "", "its"]


def test_string_hash():
    assert fingerprint.string_hash("") == 0 and fingerprint.string_hash("é") == 233
    h = ord("a")
    h ^= ord("b") + (h << 6) + (h >> 2)
    assert fingerprint.string_hash("ab") == h % 10_000_000
    assert fingerprint.string_hash("a" * 40, 10_001) < 10_001


@settings(max_examples=60)
@given(st.text(alphabet="abcdefé\U0001f600", max_size=40), st.integers(1, 12))
def test_character_hashes(text, k):
    assert fingerprint.character_hashes(text, k).tolist() == [fingerprint.string_hash(text[i : i + k]) for i in range(len(text) - k + 1)]


@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 6))
def test_winnow(hashes, window):
    out, last = [], hashes[0] if hashes else None
    for i in range(len(hashes) - window + 1):
        w = hashes[i : i + window]
        if min(w) != last or w[-1] == min(w):
            out.append(min(w))
        last = min(w)
    assert fingerprint.winnow(np.array(hashes, np.int64), window).tolist() == out


def test_gram_methods():
    text = "the royal cart may move. soon it will."
    assert fingerprint.grams(text, "full", 3)[:2] == ["the royal cart", "royal cart may"]
    assert fingerprint.grams(text, "kth_in_sent", 2, 1) == ["royal cart", "it will"]
    assert fingerprint.grams(text, "anchor", 3) == ["royal cart may", "cart may move", "may move soon", "move soon it"]
    assert fingerprint.fingerprint("", "full", 3) == []
    with pytest.raises(ValueError):
        fingerprint.fingerprint("x", "winnow-k", 5, 4)


TWO = np.array([[1.0, 1.0], [1.2, 1.1], [1.1, 1.3], [1.4, 1.2], [1.3, 1.4], [1.2, 1.2], [10.0, 10.0], [10.5, 10.2], [10.1, 10.4]])


@pytest.mark.parametrize("method", ["kmeans", "kmedians", "agglom"])
def test_two_clusters(method):
    s = cluster.METHODS[method](TWO, k=2)
    assert s[6:].min() > s[:6].max() and s.min() >= 0 and s.max() <= 1


@pytest.mark.parametrize("method", sorted(cluster.METHODS))
def test_degenerate(method):
    width = 1
    for x in (np.zeros((1, width)), np.ones((4, width)), np.zeros((2, width))):
        s = cluster.METHODS[method](x, k=2)
        assert len(s) == len(x) and np.isfinite(s).all()


def test_viterbi():
    rng = random.Random(1)
    emit = np.log(np.array([[rng.uniform(0.05, 1) for _ in range(2)] for _ in range(8)]))
    begin = np.log([0.5, 0.5])

    def likelihood(path):
        return begin[path[0]] + sum(emit[i, s] for i, s in enumerate(path)) + sum(cluster.STAY[a, b] for a, b in zip(path, path[1:]))

    best = max((tuple(int(b) for b in f"{k:08b}") for k in range(256)), key=likelihood)
    path, p = cluster.viterbi(emit, cluster.STAY, begin)
    assert tuple(path) == best and math.isclose(p, likelihood(best))


def test_hmm_variants():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (30, 1)), np.random.default_rng(1).normal(0, 3, (8, 1))])
    for v in (1, 2, 3, 4):
        s = cluster.score_hmm(x, variant=v)
        assert ((0 <= s) & (s <= 1)).all()
    path = cluster.hmm(x)
    assert path[:30].mean() < 0.2 and path[30:].mean() > 0.7


def test_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = network.train(x, y)
    assert ((net(x)[:, 0] > 0.5) == y).mean() > 0.9
    again = network.read_xml(network.write_xml(net))
    assert np.allclose(again(x), net(x))
