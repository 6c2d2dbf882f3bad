"""All stylometric features of some texts at once, on numpy arrays.

The words, sentences and paragraphs of a chunk of texts lie on one line of offsets, each text a little behind the one before.
What a unit touches is then a range of the units below it, found by binary search, and every additive figure of a range is a
difference of running sums: a passage costs the same however long it is, and no word leaves the chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from stemmata.functions import lexicon as lx
from stemmata.functions import tokenize as tk

GAP = 2
VOCABULARY = 400_000


class Words:
    """What is known of each different token, by number; forgotten when there are ``VOCABULARY`` of them."""

    COLUMNS = ("chars", "syllables", "complex", "stop", "complexity", "tag", "unigram", "norm", "stem")

    def __init__(self, lexicon: lx.Lexicon):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.keys: dict[str, int] = {}  # of normal forms, stems and tags
        self.rows = np.zeros((1024, len(self.COLUMNS)), np.int64)

    def ids(self, tokens: list[str]) -> list[int]:
        new = set(tokens).difference(self.number)
        if new:
            self._learn(sorted(new))
        return [self.number[t] for t in tokens]

    def _learn(self, tokens: list[str]) -> None:
        at = len(self.number)
        if at + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(tokens)), self.rows.shape[1]), np.int64)])
        l = self.lexicon
        key = lambda s: self.keys.setdefault(s, len(self.keys))
        for k, t in enumerate(tokens, at):
            n = l.norm(t)
            syllables, tag = l.count_syllables(t, n), l.tag(t, n)
            weight = 2 * (n in lx.SUBORDINATING) + 2 * (tag in lx.WH) + tag.startswith("VB")
            bare = t.strip(".").lower()
            self.number[t] = k
            self.rows[k] = (len(t), syllables, syllables > 2, n in l.stop, weight, key("tag " + tag), lx.UNIGRAMS.index(bare) if bare in lx.UNIGRAMS else -1, key(n), key(l.stem(n)))


_known: dict[str, Words] = {}


def words_of(lexicon: lx.Lexicon) -> Words:
    """A worker's words: kept from task to task as long as the lexicon is the same."""
    key = lexicon.digest()
    if key not in _known:
        _known.clear()
        _known[key] = Words(lexicon)
    return _known[key]


def ranges(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some ordered spans overlap each [a, b): the first, and one behind the last."""
    lo = np.searchsorted(ends, a, "right")
    return lo, np.maximum(lo, np.searchsorted(starts, b, "left"))


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of every member of some ranges."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def total(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.append(0, np.cumsum(x))
    return c[hi] - c[lo]


def spread(v: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The population deviation of each owner's values; NaN without any."""
    with np.errstate(all="ignore"):
        count = np.bincount(owner, minlength=n)
        mean = np.bincount(owner, v, n) / count
        return np.sqrt(np.bincount(owner, (v - mean[owner]) ** 2, n) / count)


class Sums(dict):
    """Additive figures of ranges of words by name; ``over`` adds them up over ranges of those."""

    def over(self, lo: np.ndarray, hi: np.ndarray) -> Sums:
        return Sums({k: total(v, lo, hi) for k, v in self.items()})

    def value(self, base: str) -> np.ndarray:
        """A word feature; NaN without words."""
        n = self["words"]
        with np.errstate(all="ignore"):
            if base in ("num_chars", "syntactic_complexity") or "," in base:
                return np.where(n > 0, self[{"num_chars": "chars", "syntactic_complexity": "complexity"}.get(base, base)].astype(np.float64), np.nan)
            part = {"average_word_length": "chars", "average_syllables_per_word": "syllables", "stopword_percentage": "stop", "avg_internal_word_freq_class": "internal", "avg_external_word_freq_class": "external"}[base]
            return self[part] / n


def honore(words: np.ndarray, stems: np.ndarray, once: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return 100 * np.log(words.astype(np.float64)) / (1 - once / (stems + 1))


class Chunk:
    """Some texts, cut; ``external`` gives the classes of some different words of a text, or is None."""

    def __init__(self, texts: list[str], kind: str, n: int, words: Words, external: Callable[[int, list[str]], np.ndarray] | None = None):
        if len(words.number) > VOCABULARY:
            words.clear()
        self.texts, self.words, self.kind, self.n = texts, words, kind, n
        self.cache: dict[str, object] = {}
        sizes = np.array([len(t) + GAP for t in texts], np.int64)
        self.bases = np.cumsum(sizes) - sizes
        flat: list[str] = []
        ends, counts = [], []
        for text, base in zip(texts, self.bases.tolist()):
            tokens, at = tk.tokens(text)
            flat += tokens
            ends.append(np.array(at, np.int64) + base)
            counts.append(len(tokens))
        self.we = np.concatenate([np.zeros(0, np.int64), *ends])
        self.ws = self.we - np.fromiter(map(len, flat), np.int64, len(flat))
        self.doc = np.repeat(np.arange(len(texts)), counts)
        ids = np.array(words.ids(flat), np.int64)
        self.rows = words.rows[ids]
        (self.a, self.b), self.atom_doc, self.atom_num = self.cut(kind)
        self.external = None
        if external:
            names, norm, out, at = list(words.keys), self.column("norm"), np.zeros(len(flat), np.int64), 0
            for d, count in enumerate(counts):
                different, back = np.unique(norm[at : at + count], return_inverse=True)
                out[at : at + count] = external(d, [names[k] for k in different.tolist()])[back]
                at += count
            self.external = out

    def cut(self, kind: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(starts, ends), text and number of all spans of a kind."""
        each = [np.array(tk.tokenize(t, kind, self.n), np.int64).reshape(-1, 2) + base for t, base in zip(self.texts, self.bases.tolist())]
        at = np.concatenate([np.zeros((0, 2), np.int64), *each])
        counts = [len(x) for x in each]
        return (at[:, 0].copy(), at[:, 1].copy()), np.repeat(np.arange(len(each)), counts), np.concatenate([np.zeros(0, np.int64), *map(np.arange, counts)])

    def spans(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name == "word":
            return self.ws, self.we
        return (self.a, self.b) if name == "atom" else self.once(f"spans {name}", lambda: self.cut(name)[0])  # type: ignore[return-value]

    def once(self, name: str, make: Callable[[], object]):
        if name not in self.cache:
            self.cache[name] = make()
        return self.cache[name]

    def column(self, name: str) -> np.ndarray:
        return self.rows[:, Words.COLUMNS.index(name)]

    def internal(self) -> np.ndarray:
        """floor(log2(highest / own frequency)) of each word in its text."""
        key = self.doc * (len(self.words.keys) + 1) + self.column("norm")
        kinds, back, count = np.unique(key, return_inverse=True, return_counts=True)
        owner = kinds // (len(self.words.keys) + 1)
        most = np.zeros(len(self.texts), np.int64)
        np.maximum.at(most, owner, count)
        return np.floor(np.log2(most[owner] / np.maximum(count, 1))).astype(np.int64)[back]

    def sums(self, lo: np.ndarray, hi: np.ndarray) -> Sums:
        """All additive figures of ranges of words."""
        plain = self.once("plain", self._plain)
        out = Sums({k: total(v, lo, hi) for k, v in plain.items()})  # type: ignore[attr-defined]
        out["words"] = hi - lo
        for name, v in self.once("triples", self._triples).items():  # type: ignore[attr-defined]
            out[name] = total(v, lo, np.maximum(hi - 2, lo))
        return out

    def _plain(self) -> dict[str, np.ndarray]:
        out = {k: self.column(k) for k in ("chars", "syllables", "complex", "stop", "complexity")}
        out |= {f"word_unigram,{w}": (self.column("unigram") == k).astype(np.int64) for k, w in enumerate(lx.UNIGRAMS)}
        out["internal"] = self.internal()
        if self.external is not None:
            out["external"] = self.external
        return out

    def _triples(self) -> dict[str, np.ndarray]:
        tag, keys = self.column("tag"), self.words.keys
        out = {}
        for t in lx.POS_TRIGRAMS:
            a, b, c = (keys.get("tag " + x, -1) for x in t.split(","))
            hit = np.zeros(len(tag), np.int64)
            if len(tag) > 2:
                hit[:-2] = (tag[:-2] == a) & (tag[1:-1] == b) & (tag[2:] == c)
            out[f"pos_trigram,{t}"] = hit
        return out

    def touched(self, outer: str, inner: str) -> tuple[np.ndarray, np.ndarray]:
        return self.once(f"{outer} {inner}", lambda: ranges(*self.spans(inner), *self.spans(outer)))  # type: ignore[return-value]

    def own(self) -> Sums:
        return self.once("own", lambda: self.sums(*self.touched("atom", "word")))  # type: ignore[return-value]

    def by_sentence(self) -> Sums:
        return self.once("by sentence", lambda: self.sums(*self.touched("sentence", "word")))  # type: ignore[return-value]

    def by_paragraph(self) -> Sums:
        return self.once("by paragraph", lambda: self.sums(*self.touched("paragraph", "word")))  # type: ignore[return-value]

    def stems(self, owner: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different stems, those seen once, sum of squared frequencies) of each owner's words."""
        size = len(self.words.keys) + 1
        kinds, count = np.unique(owner * size + self.column("stem")[word], return_counts=True)
        of = kinds // size
        return np.bincount(of, minlength=n), np.bincount(of[count == 1], minlength=n), np.bincount(of, count.astype(np.float64) ** 2, n)

    def sentence_level(self) -> dict[str, np.ndarray]:
        lo, hi = self.touched("atom", "sentence")
        s, n = self.by_sentence().over(lo, hi), hi - lo
        owner, sentence = expand(lo, hi)
        wlo, whi = (x[sentence] for x in self.touched("sentence", "word"))
        part, word = expand(wlo, whi)
        v, v1, m2 = self.stems(owner[part], word, len(self.a))
        with np.errstate(all="ignore"):
            length = s["words"] / n
            out = {
                "average_sentence_length": length, "gunning_fog_index": 0.4 * (length + 100 * s["complex"] / s["words"]), "honore_r_measure": honore(s["words"], v, v1),
                "yule_k_characteristic": 10000.0 * (m2 - v) / np.maximum(1, v * v), "syntactic_complexity_average": s["complexity"] / n,
            }
        return {k: np.where(s["words"] > 0, x, np.nan) for k, x in out.items()}

    def paragraph_level(self, parts: list[str]) -> dict[str, np.ndarray]:
        """Sums over the paragraphs with words that each passage touches, and the readability of the first of them."""
        p = self.by_paragraph()
        lo, hi = self.touched("atom", "paragraph")
        owner, par = expand(lo, hi)
        some = p["words"][par] > 0
        owner, par = owner[some], par[some]
        wlo, whi = self.touched("paragraph", "word")
        v, v1, _ = self.stems(*expand(wlo, whi), len(wlo))
        slo, shi = self.touched("paragraph", "sentence")
        with np.errstate(all="ignore"):
            per, syllables = p["words"] / (shi - slo), p["syllables"] / p["words"]
            values = {x: p.value(x) for x in parts} | {"honore_r_measure": honore(p["words"], v, v1), "flesch_reading_ease": 206.835 - 1.015 * per - 84.6 * syllables, "flesch_kincaid_grade": 0.39 * per + 11.8 * syllables - 15.59}
        n = len(self.a)
        there = np.bincount(owner, minlength=n) > 0
        out = {x: np.where(there, np.bincount(owner, y[par], n), np.nan) for x, y in values.items()}
        first = np.full(n, -1)
        first[owner[::-1]] = par[::-1]
        for x in ("flesch_reading_ease", "flesch_kincaid_grade"):
            out[f"first {x}"] = np.where(first >= 0, values[x][first], np.nan) if len(wlo) else np.full(n, np.nan)
        return out

    def char_level(self) -> dict[str, np.ndarray]:
        size = int(self.bases[-1]) + len(self.texts[-1]) + GAP if self.texts else 0
        codes = np.zeros(size, np.uint32)
        for base, text in zip(self.bases, self.texts):
            codes[base : base + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.where((codes >= 65) & (codes <= 90), codes + 32, np.where(codes == 0x212A, 107, codes))  # the Kelvin sign is a K
        letter = (small >= 97) & (small <= 122)
        vowel = np.isin(small, [97, 101, 105, 111, 117])
        kind = np.where(vowel, "V", np.where(letter, "C", "."))
        n = self.b - self.a
        out = {"punctuation_percentage": total(np.isin(codes, [ord(c) for c in lx.MARKS]), self.a, self.b) / np.maximum(n, 1)}
        for t in lx.VOWEL_TRIGRAMS:
            x, y, z = t.split(",")
            hit = np.zeros(size, np.int64)
            if size > 2:
                hit[:-2] = (kind[:-2] == x) & (kind[1:-1] == y) & (kind[2:] == z)
            out[f"vowelness_trigram,{t}"] = total(hit, self.a, np.maximum(self.b - 2, self.a)).astype(np.float64)
        return out

    def nested(self, wrappers: list[str], base: str, of_sentence: bool) -> np.ndarray:
        """``avg``: the inner value over the whole range by the number of its units; ``std``: the deviation of the units' values."""
        n = len(self.a)
        with np.errstate(all="ignore"):
            if of_sentence or len(wrappers) == 2:
                p = self.by_paragraph()
                lo, hi = self.touched("atom", "paragraph")
                owner, par = expand(lo, hi)
                slo, shi = self.touched("paragraph", "sentence")
                some = p["words"][par] > 0
                number = np.bincount(owner[some], minlength=n)
                sentences = np.bincount(owner, (shi - slo)[par].astype(np.float64), n)
                if of_sentence:
                    top = p["words" if base == "average_sentence_length" else "complexity"]
                    if wrappers == ["std"]:
                        return spread((top / (shi - slo))[par[some]], owner[some], n)
                    return np.bincount(owner[some], top[par[some]].astype(np.float64), n) / sentences / number
                if wrappers[1] == "avg":
                    return p.over(lo, hi).value(base) / sentences / number
                part, sentence = expand(slo[par], shi[par])
                return spread(self.by_sentence().value(base)[sentence], owner[part], n) / number
            lo, hi = self.touched("atom", "sentence")
            if wrappers == ["avg"]:
                return self.by_sentence().over(lo, hi).value(base) / np.maximum(hi - lo, 1)
            owner, sentence = expand(lo, hi)
            return spread(self.by_sentence().value(base)[sentence], owner, n)
