"""Organisation names as typed, taken apart: trade, proper words, initials."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from bocage.llm.spelling import NUMBER_WORDS, KnownWords, fold, same_word, undot

#: Words that carry a trade, with the trade each shows; fixed vocabulary.
TRADE_WORDS = {
    "dentaire": "dent", "dentaires": "dent", "dent": "dent", "dentistes": "dent", "dentiste": "dent", "chirurgiens": "dent",
    "medical": "med", "med": "med", "medicaux": "med", "polyvalent": "poly", "poly": "poly",
    "infirmier": "inf", "infirmiers": "inf", "inf": "inf", "csi": "inf",
    "pharmacie": "pharm", "phcie": "pharm", "phie": "pharm", "pharm": "pharm", "officine": "pharm",
    "laboratoire": "labo", "labo": "labo", "lab": "labo", "lbm": "labo", "biologie": "labo",
    "kinesitherapie": "kine", "kine": "kine", "kines": "kine", "kinesitherapeutes": "kine",
    "ophtalmologie": "ophta", "ophtalmo": "ophta", "ophta": "ophta", "ophtalmologistes": "ophta",
    "imagerie": "imag", "radiologie": "imag", "radio": "imag",
    "msp": "msp", "maison": "msp", "pluriprofessionnelle": "msp", "pluripro": "msp",
}
#: Words that show a centre or a practice.
FORM_WORDS = {"centre": "c", "ctre": "c", "cds": "c", "cs": "c", "csi": "c", "cabinet": "k", "cab": "k"}
#: Trades of health centres.
HEALTH_CENTRE = frozenset(("dent", "med", "poly", "inf"))
#: Legal forms and filler words, dropped.
_LEGAL = frozenset(
    "selarl selas sas sasu sarl eurl scp scm sisa sci sa snc association assoc asso ass mutuelle mut ste societe groupe grp".split()
)
_PHRASES = re.compile(
    r"\b(?:ste|societe)\s+(?:d\s*'?\s*exercice\s+liberal(?:e)?(?:\s+a\s+responsabilite\s+limitee)?"
    r"|civile\s+de\s+moyens|civile\s+professionnelle|par\s+actions\s+simplifiee|a\s+responsabilite\s+limitee)\b"
)
_FILLER = frozenset("de du des la le les l d et en a aux au sante soins medicale biologie medicales unknown".split())
_TITLE = frozenset("docteur docteurs dr drs doct".split())
_LONG_TRADE = [w for w in (*TRADE_WORDS, "centre", "cabinet", "medicale") if len(w) >= 6]
_MISSPELT = KnownWords(_LONG_TRADE, lambda w: 1 if len(w) < 10 else 2)
#: Legal forms as written, with the one each shows.
_LEGAL_OF = {
    "selarl": "selarl", "sas": "sas", "sasu": "sas", "sarl": "sarl", "eurl": "eurl", "scp": "scp", "scm": "scm", "sisa": "sisa",
    "association": "assoc", "assoc": "assoc", "asso": "assoc", "ass": "assoc", "mutuelle": "mut", "mut": "mut",
}
#: Words shared by many names, which never stand for one alone.
COMMON = frozenset(
    "saint sainte val pays vallees vallee pins chenes tilleuls moulins cedres ormeaux collines rivieres fontaines "
    "2 3 4 5 6 7 8 9 10 11".split()
)


class Name(NamedTuple):
    trades: frozenset
    form: str
    words: tuple[str, ...]  # proper words, sorted
    initials: tuple[str, ...]
    doctor: bool
    legal: str = ""
    last: str = ""  # the last proper word as written: the surname where a doctor is named


@lru_cache(maxsize=50_000)
def _vocabulary(word: str) -> str:
    """The trade or form word a token is, up to one typing error in the long ones."""
    if word in TRADE_WORDS or word in FORM_WORDS or word in _LEGAL or word in _FILLER or word in _TITLE:
        return word
    return _MISSPELT.find(word) if len(word) >= 6 else ""


@lru_cache(maxsize=50_000)
def parse_name(text: str | None, town: str | None = "") -> Name:
    """The parts of one name; null, blank and sentinel names have no words.

    The town, given apart, is dropped where a name ends with it.
    """
    low = undot(fold(text).replace("_", " "))
    phrase = _PHRASES.search(low)
    legal = ""
    if phrase:
        said = phrase.group()
        legal = "selarl" if "exercice" in said else "scm" if "moyens" in said else "scp" if "professionnelle" in said else "sas" if "actions" in said else "sarl"
        low = _PHRASES.sub(" ", low)
    tokens = [t for t in re.split(r"[^a-z0-9]+", low) if t]
    place = [t for t in re.split(r"[^a-z0-9]+", re.sub(r"\bcedex\b.*", "", fold(town))) if t]
    expand = {"st": "saint", "ste": "sainte", "s": "sous"}
    plain = [expand.get(t, t) for t in tokens]
    place = [expand.get(t, t) for t in place]
    if place and len(plain) > len(place) and "".join(plain[-len(place) :]) == "".join(place):
        tokens = tokens[: -len(place)]
    trades, form, words, initials, doctor = set(), "", [], [], False
    for t in tokens:
        known = _vocabulary(t)
        legal = legal or _LEGAL_OF.get(t, "")
        if known in _TITLE and known:
            doctor = True
        elif known:
            form = FORM_WORDS.get(known, form) if known in FORM_WORDS else form
            if known in TRADE_WORDS:
                trades.add(TRADE_WORDS[known])
        elif len(t) == 1:
            if t.isdigit():
                words.append(t)
            else:
                initials.append(t)
        else:
            words.append({"st": "saint", "ste": "sainte"}.get(t, NUMBER_WORDS.get(t, t)))
    if "medicale" in tokens and "labo" in trades:
        trades.discard("med")
    if "soins" in tokens and "inf" not in trades and not trades and form == "c":
        trades.add("inf")
    return Name(frozenset(trades), form, tuple(sorted(words)), tuple(initials), doctor, legal, words[-1] if words else "")


def trades_agree(a: Name, b: Name) -> int:
    """1 where trade and form agree, 0 where one is unknown, -1 where they conflict."""
    if a.form and not a.trades and b.form:
        # "centre de santé" without a speciality is any health centre, and only that.
        return 0 if a.form == b.form and (a.form != "c" or b.trades & HEALTH_CENTRE) else -1
    if a.trades and b.trades:
        if not (a.trades & b.trades):
            return -1
        if a.form and b.form and a.form != b.form and (a.trades & b.trades) & {"dent", "inf", "med"}:
            return -1
        return 1
    return 0


def variants(name: Name) -> list[tuple[str, int]]:
    """Canonical strings of a name with the words each leaves out: all of them, and all but one.

    Words are sorted, so order does not matter; a string of common words alone is no variant.
    """
    words = list(name.words)
    if not words:
        return []
    out = {" ".join(words): 0}
    if len(words) > 1:
        for i in range(len(words)):
            rest = words[:i] + words[i + 1 :]
            if any(w not in COMMON and len(w) > 2 for w in rest):
                out.setdefault(" ".join(rest), 1)
    if name.doctor and name.last and name.last not in COMMON:
        out.setdefault(name.last, len(words) - 1)
    return list(out.items())


@lru_cache(maxsize=50_000)
def name_overlap(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, int, int]:
    """(matched proper words, words only in a, words only in b), typing errors aside."""
    left, right, hits = list(a), list(b), 0
    for exact in (True, False):
        for w in list(left):
            other = next((v for v in right if (w == v if exact else same_word(w, v))), None)
            if other is not None:
                left.remove(w)
                right.remove(other)
                hits += w not in COMMON
    return hits, sum(w not in COMMON for w in left), sum(w not in COMMON for w in right)
