"""Text as Column expressions: folding, keys, and set or multiset similarities.

Accents go by canonical decomposition, as Unicode defines it for all letters of one base letter
and marks; letters without one pass through unchanged.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposable() -> tuple[str, str]:
    """The lower-case letters that decompose into one letter and marks, those letters, and the marks alone, which go."""
    seen, plain = [], []
    for code in range(0xC0, 0x3000):
        whole = chr(code)
        parts = unicodedata.normalize("NFD", whole)
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(base) == 1 and whole == whole.lower():
            seen.append(whole)
            plain.append(base[0])
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(seen + marks), "".join(plain)


_ACCENTED, _PLAIN = _decomposable()


def strip_accents(value: Column) -> Column:
    """Lower case, ligatures opened, accents and lone marks removed."""
    low = F.lower(value)
    for ligature, letters in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
        low = F.replace(low, F.lit(ligature), F.lit(letters))
    return F.translate(low, _ACCENTED, _PLAIN)


def compare_key(value: Column) -> Column:
    """Names for comparison: folded, punctuation and blanks as one space, ends trimmed."""
    return F.trim(F.regexp_replace(strip_accents(value), r"[.,'’\-\s]+", " "))


def commune_key(value: Column) -> Column:
    """Commune names for equality: folded, CEDEX gone, st, ste, s/ and s/s in full, letters only."""
    low = F.regexp_replace(strip_accents(value), r"\bcedex\b\s*\d*", " ")
    low = F.regexp_replace(low, r"\bs/s\b", " sous ")
    low = F.regexp_replace(low, r"\bs/\s*", " sur ")
    low = F.regexp_replace(low, r"\bste\b", "sainte")
    low = F.regexp_replace(low, r"\bst\b", "saint")
    return F.regexp_replace(low, r"[^a-z0-9]+", "")


def clean_text(value: Column) -> Column:
    """Control characters and runs of blanks as one space, ends trimmed, blank as null."""
    return non_empty(F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1f]+", " "), r"\s+", " "))


def non_empty(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


_UNICODE_SPACES = "[\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Letters whose upper case differs between engines, replaced before upper-casing; fixed values.
_CASE_TRAPS = (
    ("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn"), ("ǰ", "ǰ"),
)


def strip_cedex(value: Column) -> Column:
    """Without the CEDEX mention and its number."""
    return F.regexp_replace(value, r"(?i)\bCEDEX[ \t\n\x0B\f\r]*\d*", " ")


def key_field(value: Column) -> Column:
    """One component of an address key: spaces unified, CEDEX gone, upper case; null is empty."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), _UNICODE_SPACES, " ")
    text = F.trim(F.regexp_replace(strip_cedex(text), r"[ \t\n\x0B\f\r]+", " "))
    for letter, plain in _CASE_TRAPS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.upper(text)


def address_key(address: Column, postal: Column, commune: Column) -> Column:
    """Geocode-cache key: three normalised components, empty ones kept."""
    return F.concat_ws("|", key_field(address), key_field(postal), key_field(commune))


def commune_name(value: Column) -> Column:
    """Commune name in capitals: no accents, hyphens and marks as spaces, ST and STE in full."""
    text = F.upper(strip_accents(value))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[-'’,.]", " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(text, r"\bSTE\b", "SAINTE"), r"\bST\b", "SAINT")


#: Street words as abbreviated, and in full; fixed values.
STREET_ABBREVIATIONS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bvd": "boulevard", "boul": "boulevard",
    "pl": "place", "all": "allee", "che": "chemin", "chem": "chemin", "rte": "route", "imp": "impasse", "sq": "square",
    "qu": "quai", "crs": "cours", "pas": "passage", "fbg": "faubourg", "st": "saint", "ste": "sainte",
}


def expand_abbreviations(normalised: Column) -> Column:
    """Each word of a normalised address in full where it is a known abbreviation."""
    known = F.create_map(*[F.lit(x) for pair in STREET_ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(F.split(normalised, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def geocoder_line(address: Column) -> Column:
    """Street line for a geocoder: cut at the first comma if it starts with a number, leading zeros
    and a lone zero gone; unchanged where no letter would be left."""
    line = F.when((F.instr(address, ",") > 0) & address.rlike(r"^\s*\d"), F.substring_index(address, ",", 1)).otherwise(address)
    out = F.regexp_replace(F.regexp_replace(line, r"^(\s*)0*(\d+)(\s|$)", "$1$2$3"), r"^(\s*)0(\s|$)", "$1")
    return F.when(out.rlike("[A-Za-z]"), out).otherwise(address)


def shortened(value: Column, most: int) -> Column:
    """Text of at most ``most`` characters for a message, an ellipsis for what is cut."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 1), F.lit("…")))


def csv_value(value: Column, sep: str = ",") -> Column:
    """A value as it stands in a delimited file: quoted where it must be, quotes doubled; null is empty."""
    special = value.contains(sep) | value.contains('"') | value.contains("\n") | value.contains("\r")
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(special, quoted).otherwise(value), F.lit(""))


def first_phone(value: Column) -> Column:
    """The first number of a list, without separators."""
    return non_empty(F.regexp_replace(F.element_at(F.split(value, "[/;,]"), 1), r"[\s.\-()]", ""))


def _grams(text: Column, size: int) -> Column:
    return F.when(
        F.length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: text.substr(i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def let(values: dict[str, Column], body) -> Column:
    """``body`` over values computed once: a lambda would otherwise compute its outer expressions anew for each element."""
    bound = F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)
    return F.element_at(bound, 1)


def _numbered(grams: Column) -> Column:
    """Grams told apart by their how-manieth occurrence, so set operations act on the multiset."""
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.transform(grams, lambda g: F.concat(g, F.lit("1")))).otherwise(
        F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    )


def numbered_pairs(value: Column) -> Column:
    """The letter pairs of a text, each told apart by its occurrence."""
    return F.element_at(F.transform(F.array(_grams(value, 2)), _numbered), 1)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over the multisets of letter pairs: 1 where equal, 0 below two letters, null for null."""

    def score(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["na"], s["nb"]))
        return F.try_divide(F.lit(2.0) * shared, F.size(s["na"]) + F.size(s["nb"]))

    def scored(t: Column) -> Column:
        numbered = let({"ga": _grams(t["a"], 2), "gb": _grams(t["b"], 2)}, lambda g: F.struct(_numbered(g["ga"]).alias("na"), _numbered(g["gb"]).alias("nb")))
        short = (F.length(t["a"]) < 2) | (F.length(t["b"]) < 2)
        return F.when(t["a"].isNull() | t["b"].isNull(), None).when(t["a"] == t["b"], 1.0).when(short, 0.0).otherwise(let({"n": numbered}, lambda n: score(n["n"])))

    return let({"a": a, "b": b}, scored)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 where neither text has a word."""
    ratio = lambda t: F.try_divide(F.size(F.array_intersect(t["ta"], t["tb"])), F.size(F.array_union(t["ta"], t["tb"])).cast("double"))
    return F.coalesce(let({"ta": trigrams(a), "tb": trigrams(b)}, ratio), F.lit(0.0))


def word_similarity(query: Column, text: Column) -> Column:
    """Greatest trigram similarity of the query to any run of words of the text.

    Runs of whole words stand for the continuous extents of the trigram list; as a definition
    of its own it is exact, as the other it is an approximation at word borders.
    """
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    by_word = F.transform(split, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))

    def best(s: Column) -> Column:
        n = F.size(s["words"])
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def likeness(run: Column) -> Column:
            return F.size(F.array_intersect(s["tq"], run)) / F.size(F.array_union(s["tq"], run)).cast("double")

        def run(i: Column, j: Column) -> Column:
            return let({"run": F.array_distinct(F.flatten(F.slice(s["words"], i, j - i + 1)))}, lambda r: likeness(r["run"]))

        return F.array_max(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, n), lambda j: run(i, j)))))

    return F.coalesce(let({"tq": trigrams(query), "words": by_word}, best), F.lit(0.0))
