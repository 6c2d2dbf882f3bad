"""Small word lists and rules that stand in for trained taggers and dictionaries; each can be replaced by a table.

Syllables of a word are its length modulo 3, the stem is the lower-case word without punctuation, and tags come from
closed word lists and endings: approximations, applied alike everywhere. A ``Lexicon`` with tables of one's own gives a word
the table's entry, and the rule's only where it has none.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.functions.tokenize import PUNCTUATION, without_punctuation

STOP = "a an and are as at be been but by for from had has have he her his i if in is it its my no not of on or our she so than that the their them they this to was we were what when which who will with would you your".split()
SUBORDINATING = "since because as that while unless until than though although".split()
TAGS: list[tuple[str, list[str]]] = [
    ("DT", "the a an this these those each every some any no".split()),
    ("IN", "of in to for with on at by from as into about than over under after before between through because while since until though although unless that".split()),
    ("CC", "and or but nor yet".split()),
    ("WP", "who what whom".split()),
    ("WP$", ["whose"]),
    ("WDT", ["which"]),
    ("WRB", "when where why how".split()),
    ("VB", "is was are were be been am has have had do does did can could will would shall should may might must go goes went said".split()),
]
WH = ["WP", "WP$", "WDT", "WRB"]
POS_TRIGRAMS = ["NN,VB,NN", "NN,NN,VB", "VB,NN,NN", "NN,IN,NP", "NN,NN,CC", "NNS,IN,DT", "DT,NNS,IN", "VB,NN,VB", "DT,NN,IN", "NN,NN,NN", "NN,IN,DT", "NN,IN,NN", "VB,IN,DT"]
VOWEL_TRIGRAMS = ["C,V,C", "C,V,V", "V,V,C", "V,V,V"]
UNIGRAMS = ["is", "of", "been", "the"]
#: What counts as punctuation for the share of punctuation characters: no ``+``, no ``=`` and no backslash.
MARKS = "".join(c for c in PUNCTUATION if c not in "+=\\")


def norm(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"[!-/:-@\[-`{-~]", ""))


def tag(w: Column) -> Column:
    """A tag for each token: closed classes, then endings, then capitals (NP); all else is NN."""
    n = norm(w)
    out = F.when(n == "", F.lit("."))
    for name, members in TAGS:
        out = out.when(n.isin(members), name)
    return out.when(n.rlike("(ed|ing)$"), "VB").when(w.rlike("^[A-Z]"), "NP").when(n.endswith("s"), "NNS").otherwise("NN")


_CLOSED = {w: name for name, members in reversed(TAGS) for w in members}
_CAPITAL = re.compile("[A-Z]")


class Lexicon(NamedTuple):
    """Stop words, and what tables say of a word: keys are lower case without punctuation.

    It is sent to every worker, so ``of`` refuses tables of more than ``MAX_ROWS`` rows.
    """

    stop: frozenset[str] = frozenset(STOP)
    stems: dict[str, str] = {}
    syllables: dict[str, int] = {}
    tags: dict[str, str] = {}

    @classmethod
    def of(cls, stop: DataFrame | None = None, stems: DataFrame | None = None, syllables: DataFrame | None = None, tags: DataFrame | None = None) -> Lexicon:
        """From tables ``stop(word)``, ``stems(word, stem)``, ``syllables(word, syllables)`` and ``tags(word, tag)``; of repeated words the least entry counts, nulls are left out."""
        out: dict[str, object] = {}
        for name, table in (("stop", stop), ("stems", stems), ("syllables", syllables), ("tags", tags)):
            if table is None:
                continue
            value = table.columns[1] if name != "stop" else table.columns[0]
            rows = table.select(norm(F.col(table.columns[0])).alias("w"), F.col(value).alias("v")).where("w IS NOT NULL AND v IS NOT NULL").groupBy("w").agg(F.min("v").alias("v")).limit(MAX_ROWS + 1).collect()
            if len(rows) > MAX_ROWS:
                raise ValueError(f"the table of {name} has more than {MAX_ROWS} words")
            out[name] = frozenset(r.w for r in rows) if name == "stop" else {r.w: r.v for r in rows}
        return cls(**out)  # type: ignore[arg-type]

    def digest(self) -> str:
        return hashlib.sha256(repr([sorted(self.stop), *(sorted(d.items()) for d in self[1:])]).encode()).hexdigest()

    @staticmethod
    def norm(token: str) -> str:
        return without_punctuation(token).lower()

    def stem(self, n: str) -> str:
        return self.stems.get(n, n)

    def count_syllables(self, token: str, n: str) -> int:
        return self.syllables.get(n, len(token) % 3)

    def tag(self, token: str, n: str) -> str:
        if n in self.tags:
            return self.tags[n]
        if n == "":
            return "."
        if n in _CLOSED:
            return _CLOSED[n]
        return "VB" if n.endswith(("ed", "ing")) else "NP" if _CAPITAL.match(token) else "NNS" if n.endswith("s") else "NN"


MAX_ROWS = 500_000
