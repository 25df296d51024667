"""Postal addresses as typed, taken apart: number, suffix, street type, street words, named place."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from bocage.llm.spelling import NUMBER_WORDS, KnownWords, fold, same_word, undot

#: Street types and their usual abbreviations.
STREET_TYPES = {
    "rue": "rue r", "avenue": "avenue ave av aven", "boulevard": "boulevard boul bvd bld bd blvd",
    "chemin": "chemin chem che ch chm", "allee": "allee allees all al", "impasse": "impasse imp", "place": "place plce pl",
    "square": "square sq", "quai": "quai qu q", "route": "route rte rt", "faubourg": "faubourg faub fbg fg",
    "cours": "cours crs", "passage": "passage pass psg", "sentier": "sentier sent", "venelle": "venelle ven",
    "esplanade": "esplanade esp", "promenade": "promenade prom", "montee": "montee mte", "ruelle": "ruelle rle",
}
_TYPE_OF = {short: full for full, shorts in STREET_TYPES.items() for short in shorts.split()}

#: Titles and kinds that head a street name, with their abbreviations.
_WORDS = {
    "st": "saint", "ste": "sainte", "dr": "docteur", "doct": "docteur", "cap": "capitaine", "capit": "capitaine",
    "cne": "capitaine", "gal": "general", "gen": "general", "prof": "professeur", "pr": "professeur",
    "cdt": "commandant", "col": "colonel", "mal": "marechal", "lt": "lieutenant", "pdt": "president",
    "champ": "champs", "moulins": "moulin", "ecole": "ecoles", "grand": "grands", "grande": "grands", "grandes": "grands",
    "petit": "petits", "petite": "petits", "petites": "petits", "jardin": "jardins", "vieille": "vieux", "blanc": "blanche",
    **NUMBER_WORDS,
}
_KINDS = frozenset(
    "pre bois pont jardins clos docteur capitaine general professeur commandant colonel marechal lieutenant president".split()
)
#: Common nouns and adjectives of street names: unlike a given name, none may be left out.
_COMMON = _KINDS | frozenset(
    "saint sainte vieux grands petits croix blanche champs moulin gare poste marche republique lavoir tilleuls mairie "
    "acacias fontaine liberte chateau ecoles abbaye eglise stade novembre mai juillet ormeaux chenes pins cedres".split()
)
_LONG_COMMON = sorted(w for w in _COMMON if len(w) > 4)
_MISSPELT = KnownWords(_LONG_COMMON, lambda w: 1)
_SKIP = frozenset("du de des la le les l d et au aux a".split())
_MONTHS = "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"

_POSTBOX = re.compile(r"\b(?:bp|cs|b\.p\.|c\.s\.)\s*\d+")
_INNER = re.compile(
    r"\b\d+\s*(?:er|ere|eme|e|nd)\s+etage(?:\s+(?:gauche|droite))?|\betage\s+\d+|\br\.?d\.?c\.?(?![a-z])|\bacces par la cour\b"
    r"|\b(?:appt|appartement|apt|hall|porte|cabinet|local|escalier|esc|batiment|bat)\.?\s*(?:n\s*°\s*)?(?:\d+|[a-z])\b(?!')"
)
_TOWN = re.compile(r"(?:^|,|\s)\s*\d{5}\s+[a-z][^,]*(?=,|$)")
_PLACE = re.compile(r"(?<![a-z'])(residence|res\.?|immeuble|imm\.?|villa|le clos|espace|domaine|lotissement|hameau)\s+([a-z][a-z' -]*)")
_PLACE_HEADS = {"res": "residence", "imm": "immeuble"}
_NUMBER = re.compile(
    r"(?<![a-z0-9'])(?:n\s*[°o]?\s*\.?\s*)?0*(\d{1,4})\s*(?:(bis|ter|quater)\b|([bt])(?=\s*$|\s*,|\s+(?:%s)\b))?(?![0-9])"
    % "|".join(sorted(_TYPE_OF, key=len, reverse=True))
)
_MONTH_NEXT = re.compile(rf"\s*(?:{_MONTHS})\b")
_COUNTED = re.compile(r"\b(?:des|les|du)\s*$")
_GLUED = re.compile(r"(?<![a-z0-9'])(?:n\s*[°o]?\s*\.?\s*)?0*(\d{1,4})(bis|ter|quater|[bt])(?![a-z0-9'])")


@lru_cache(maxsize=50_000)
def _street_word(token: str) -> str:
    """Abbreviations in full, and common street words freed of one typing error."""
    full = _WORDS.get(token, token)
    if full in _COMMON or len(full) < 5 or full == "marie":
        return full
    return _MISSPELT.find(full) or full


class Address(NamedTuple):
    number: int  # -1 where none is shown
    suffix: str  # "", "b" or "t"
    street_type: str
    words: tuple[str, ...]  # street words in written order, initials as single letters
    place: str  # named place: head and name


EMPTY = Address(-1, "", "", (), "")


def _numbers(text: str) -> tuple[list[tuple[int, str]], str]:
    """Every reading of the house number with its suffix, the likeliest first, and the text without that one."""
    glued = _GLUED.search(text)
    out, rest = [], text
    for m in [*([glued] if glued else []), *_NUMBER.finditer(text)]:
        if _MONTH_NEXT.match(text, m.end()) and not (m.lastindex and m.lastindex > 1):
            continue
        if _COUNTED.search(text[max(0, m.start() - 40) : m.start()]):
            continue
        suffix = next((g for g in m.groups()[1:] if g), "")
        if not out:
            rest = f"{text[: m.start()]} , {text[m.end() :]}"
        out.append((int(m.group(1)), suffix[:1]))
    return list(dict.fromkeys(out)) or [(-1, "")], rest


@lru_cache(maxsize=50_000)
def parse_address(*fields: str | None) -> Address:
    """The likeliest reading of one address whose fields may hold any part, in any order.

    Null and blank fields are skipped; text without any known part gives ``EMPTY``.  The
    whole text is read, however long.
    """
    return readings(*fields)[0]


@lru_cache(maxsize=50_000)
def readings(*fields: str | None) -> tuple[Address, ...]:
    """All plausible normalised forms of one address, the likeliest first: any number may be the door, any part with a street type the street."""
    text = " , ".join(undot(f) for f in map(fold, fields) if f)
    if not text:
        return (EMPTY,)
    text = _POSTBOX.sub(" , ", text)
    text = _TOWN.sub(" ", text)
    text = _INNER.sub(" , ", text)
    places = []

    def keep(m: re.Match) -> str:
        words = m.group(2).split()
        name = []
        for w in words:
            if w in _TYPE_OF and name:
                break
            name.append(w)
        head = m.group(1).rstrip(".")
        places.append(f"{_PLACE_HEADS.get(head, head)} {' '.join(name).strip(' -')}")
        return " , " + " ".join(words[len(name) :])

    text = _PLACE.sub(keep, text)
    text = re.sub(rf"\b11\s+(?={_MONTHS})", "onze ", text)
    numbers, rest = _numbers(text)
    streets, named = _streets(rest), places or [""]
    # One part is read otherwise at a time, so a long text has no more readings than parts.
    first = Address(*numbers[0], *streets[0][:2], named[0])
    others = [first._replace(number=n, suffix=s) for n, s in numbers[1:]]
    for kind, words, own in streets[1:]:
        others.append(first._replace(street_type=kind, words=words))
        if own >= 0:
            others.append(Address(own, "", kind, words, first.place))
    return tuple(dict.fromkeys([first, *others, *(first._replace(place=p) for p in named[1:])]))


def _streets(text: str) -> list[tuple[str, tuple[str, ...], int]]:
    """Every reading of the street: its type, its words and a second number that heads it; the likeliest, typed and longest, first."""
    outer = ""
    bracket = re.search(r"\(\s*([a-z]+)\.?\s*\)", text)
    if bracket and bracket.group(1) in _TYPE_OF:
        outer = _TYPE_OF[bracket.group(1)]
        text = text[: bracket.start()] + " " + text[bracket.end() :]
    found = []
    for part in text.split(","):
        tokens = [t for t in re.split(r"[^a-z0-9]+", part) if t]
        kind, own = "", -1
        if len(tokens) > 2 and tokens[0].isdigit() and len(tokens[0]) < 5 and tokens[1] in _TYPE_OF:
            own, tokens = int(tokens[0]), tokens[1:]
        if tokens and tokens[0] in _TYPE_OF and len(tokens) > 1:
            kind, tokens = _TYPE_OF[tokens[0]], tokens[1:]
        tokens = [_street_word(t) for t in tokens if t not in _SKIP or len(t) == 1 and t not in "ld"]
        if tokens and any(len(t) > 1 for t in tokens) and not (len(tokens) == 1 and tokens[0] == "no"):
            found.append((sum(map(len, tokens)) + 100 * bool(kind), kind or outer, tuple(tokens), own))
    found.sort(key=lambda f: -f[0])
    # Parts without a street type are read as streets only where no part has one.
    typed = [f for f in found if f[0] >= 100] or found[:1]
    return [f[1:] for f in typed] or [("", (), -1)]


def _initial_of(letter: str, words: list[str]) -> str | None:
    return next((w for w in words if len(w) > 1 and w[0] == letter), None)


@lru_cache(maxsize=50_000)
def same_street(type_a: str, a: tuple[str, ...], type_b: str, b: tuple[str, ...]) -> bool:
    """One street under two spellings: order, typos, initials and a missing given name aside."""
    if (type_a and type_b and type_a != type_b) or not a or not b:
        return False
    core = False
    initials_a, initials_b = [w for w in a if len(w) == 1 and w.isalpha()], [w for w in b if len(w) == 1 and w.isalpha()]
    digits = lambda ws: sorted(w for w in ws if w.isdigit())
    if digits(a) != digits(b):
        return False
    left, right = ([w for w in ws if len(w) > 1 and not w.isdigit()] for ws in (a, b))
    for exact in (True, False):
        for w in list(left):
            other = next((v for v in right if (w == v if exact else same_word(w, v))), None)
            if other is not None:
                left.remove(w)
                right.remove(other)
                core |= w not in _KINDS and len(w) > 2
    for mine, theirs in ((initials_a, right), (initials_b, left)):
        for letter in mine:
            full = _initial_of(letter, theirs)
            if full:
                theirs.remove(full)
            elif theirs:
                return False
    if not core or (left and right):
        return False
    # One side may lack a given name, but no word that tells streets apart.
    return not any(w in _COMMON for w in left + right)


def same_place(a: str, b: str) -> bool:
    """One named place: equal head, equal name up to typing errors."""
    if not a or not b:
        return False
    heads = [2 if p.startswith("le clos ") else 1 for p in (a, b)]
    (head_a, name_a), (head_b, name_b) = ((" ".join(p.split(" ")[:n]), " ".join(p.split(" ")[n:])) for p, n in zip((a, b), heads))
    return head_a == head_b and bool(name_a) and same_word(name_a, name_b)


def same_location(a: Address, b: Address) -> bool:
    """Both show one number in one street, or one named place that nothing contradicts."""
    both_numbers = a.number >= 0 and b.number >= 0
    if both_numbers and (a.number, a.suffix) != (b.number, b.suffix):
        return False
    street = same_street(a.street_type, a.words, b.street_type, b.words)
    if both_numbers and street:
        return True
    if not same_place(a.place, b.place):
        return False
    return street or not (a.words and b.words)
