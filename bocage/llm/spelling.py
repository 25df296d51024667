"""Folding and edit distance shared by the name and address operators."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LIGATURES = str.maketrans({"œ": "oe", "æ": "ae", "Œ": "oe", "Æ": "ae", "ß": "ss", "’": "'", "‘": "'", "`": "'", "´": "'"})

#: Number words and the digits they stand for.
NUMBER_WORDS = {
    "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7",
    "huit": "8", "neuf": "9", "dix": "10", "onze": "11",
}


def fold(text: str | None) -> str:
    """Lower case without accents or ligatures, every blank a plain space, ends trimmed."""
    if not text:
        return ""
    plain = text.lower()
    if not plain.isascii() or "`" in plain:
        plain = unicodedata.normalize("NFKD", text.translate(_LIGATURES).lower())
        plain = "".join(c for c in plain if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain).strip()


def undot(text: str) -> str:
    """``s.a.s.`` to ``sas``: dotted capitals become one word; a lone initial keeps its dot."""
    return re.sub(r"(?<![a-z0-9])(?:[a-z]\.){2,}[a-z]?(?![a-z])", lambda m: m.group().replace(".", "") + " ", text)


@lru_cache(maxsize=100_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Restricted Damerau-Levenshtein distance, or ``most + 1`` as soon as it must exceed ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Only a band around the diagonal can stay within ``most``, so long texts cost no more than their length.
    far, width = most + 1, len(b) + 1
    two: dict[int, int] = {}
    one = {j: j for j in range(min(most, width - 1) + 1)}
    for i, ca in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(width - 1, i + most) + 1):
            cb = b[j - 1]
            d = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, two.get(j - 2, far) + 1)
            row[j] = d
        if min(row.values(), default=far) > most:
            return far
        two, one = one, row
    return min(one.get(len(b), far), far)


def typo_allowance(length: int) -> int:
    """Edits a word of this length may carry and still be the same word."""
    return 0 if length < 4 else 1 if length < 8 else 2


def same_word(a: str, b: str) -> bool:
    """Equal up to the typing errors its length allows."""
    allowed = typo_allowance(min(len(a), len(b)))
    return a == b or (allowed > 0 and edits(a, b, allowed) <= allowed)


def _without(word: str, most: int) -> set[str]:
    """The word and what is left of it after up to ``most`` deletions."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class KnownWords:
    """A fixed list of words with the errors each allows; finds the first in order that a misspelt word may be."""

    def __init__(self, words: list[str], allowed):
        self.allowed = [(w, allowed(w)) for w in words]
        self.most = [max((n for w, n in self.allowed if abs(len(w) - size) <= n), default=-1) for size in range(max(map(len, words)) + 3)]
        self.longest = max(len(w) + n for w, n in self.allowed)
        self.index: dict[str, list[int]] = {}
        for i, (w, n) in enumerate(self.allowed):
            for key in _without(w, n):
                self.index.setdefault(key, []).append(i)

    def find(self, word: str) -> str:
        most = self.most[len(word)] if len(word) <= self.longest else -1
        if most < 0:
            return ""
        near = {i for key in _without(word, most) for i in self.index.get(key, ())}
        return next((w for i in sorted(near) for w, n in [self.allowed[i]] if edits(word, w, n) <= n), "")


#: Words beyond this length are compared by segments, as their deletions would be too many.
LONG_WORD = 40
_SEGMENTS = 5


def deletions(word: str, most: int = 2) -> set[str]:
    """The word and what is left of it after as many deletions as it may carry errors, ``most`` at the most.

    Two words within their allowance (a swap of neighbours is one error) share one of these.
    """
    return _without(word, min(most, typo_allowance(len(word))))


def segments(word: str, probing: bool) -> set[str]:
    """Keys that two long words within two errors share: of five segments two errors, swaps too, leave one untouched.

    One side gives its own segments, the other (``probing``) what they may be in words up to two letters longer or shorter.
    """
    out = set()
    for length in range(len(word) - 2, len(word) + 3) if probing else (len(word),):
        size = length // _SEGMENTS
        for j in range(_SEGMENTS):
            for shift in (-2, -1, 0, 1, 2) if probing else (0,):
                at = j * size + shift
                if 0 <= at and at + size <= len(word):
                    out.add(f"{length}:{j}:{word[at : at + size]}")
    return out


def _keys(probing: bool, most: int):
    def run(batches):
        for pdf in batches:
            words, keys = [], []
            for word in pdf["word"]:
                found = set()
                if typo_allowance(len(word)):
                    # Words near the bound are of both kinds, so that a pair across it meets.
                    if len(word) <= LONG_WORD + 2:
                        found |= deletions(word, most)
                    if len(word) > LONG_WORD - 2:
                        found |= segments(word, probing)
                words += [word] * len(found)
                keys += found
            yield pd.DataFrame({"word": words, "key": keys})

    return run


def similar_words(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): different words of two word lists (column ``word``) that are equal up to the errors their length allows.

    None is lost that differs by at most ``most`` errors; of those with more, only some are found.
    """
    keyed = lambda df, probing: df.where("word IS NOT NULL").distinct().mapInPandas(_keys(probing, most), "word string, key string")
    a = keyed(left, False).select(F.xxhash64("key").alias("key"), F.col("word").alias("a"))
    b = keyed(right, True).select(F.xxhash64("key").alias("key"), F.col("word").alias("b"))
    met = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 2)).select("a", "b").distinct()

    def verified(batches):
        for pdf in batches:
            yield pdf.loc[[same_word(x, y) for x, y in zip(pdf["a"], pdf["b"])]]

    return met.mapInPandas(verified, "a string, b string")
