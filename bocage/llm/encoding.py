"""Problem 10: text decoded with the wrong character encoding.

A hidden Markov model labels characters with one clean state, one state per encoding pair and
one for characters already lost.  A state emits what its inverse transform makes of the
observed characters, as likely as that is in clean text of the corpus; switching states costs.
The best path is found by Viterbi's algorithm, and each labelled span gets its state's inverse.

The model of clean text, counts of each non-ASCII character between its neighbours, is trained
on all documents, then once more on those the first model finds clean.  It is bounded by
``MODEL_SIZE`` contexts (the most frequent; rarer ones count by character class).

ASCII characters look alike in every state, so only runs with other characters are labelled;
a document whose every run is likeliest clean needs no path search, as switching only costs.

Defined results: null and empty texts, and texts in ASCII, are clean; foreign words, symbols
and escapes are judged by the corpus, not by a list; U+FFFD is always damage, beyond repair.
Whole texts are read, however long.  Repeated rows are judged alike.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.session import checkpoint

MODEL_SIZE = 200_000
ENTER, LEAVE, SWITCH = 8.0, 3.0, 10.0
LOST = "�"
#: A run never starts inside a word, so every character is looked at once.
_RUN = re.compile("(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*+")
_FLOOR = 1e-9

#: (written as, read as): the encoding pairs, each a state of the model.
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"),
    ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "iso8859_15"), ("cp1252", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "mac_roman"), ("cp1252", "cp1253"), ("cp1252", "iso8859_7"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
)
TWICE = ("utf-8", "cp1252 twice")


def _high_bytes(codec: str) -> dict[str, int]:
    """Character to byte for the upper half; bytes the codec leaves open are control characters."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        if ord(c) > 0x7F:
            table.setdefault(c, b)
    return table


def _low_table(written: str, read: str) -> dict[str, str]:
    """Observed to original character for two single-byte encodings."""
    out = {}
    for seen, b in _high_bytes(read).items():
        try:
            original = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if original != seen and ord(original) > 0x7F:
            out[seen] = original
    return out


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


class _Utf8:
    """UTF-8 bytes read in a single-byte encoding: units of two to four characters."""

    def __init__(self, read: str, spaced: bool = False):
        self.byte = _high_bytes(read)
        self.spaced = spaced

    def unit(self, run: str, i: int) -> tuple[int, str] | None:
        lead = self.byte.get(run[i], 0)
        n = _length(lead)
        if self.spaced and lead == 0xC3 and i + 1 == len(run):
            return 1, "à"  # its second half, a no-break space, was made a plain one later
        if not n or i + n > len(run):
            return None
        data = bytes(self.byte.get(c, 0) for c in run[i : i + n])
        try:
            return n, data.decode("utf-8")
        except UnicodeDecodeError:
            return None


class _Single:
    def __init__(self, written: str, read: str):
        self.table = _low_table(written, read)

    def unit(self, run: str, i: int) -> tuple[int, str] | None:
        original = self.table.get(run[i])
        return (1, original) if original else None


class _Twice:
    """The damage of the first pair done two times over."""

    def __init__(self, read: str):
        self.once = _Utf8(read)

    def unit(self, run: str, i: int) -> tuple[int, str] | None:
        inner, at = "", i
        while at < len(run) and len(inner) < 4:
            step = self.once.unit(run, at)
            if step is None:
                return None
            at += step[0]
            inner += step[1]
            done = self.once.unit(inner, 0)
            if done and done[0] == len(inner):
                return at - i, done[1]
        return None


class _Lost:
    def unit(self, run: str, i: int) -> tuple[int, str] | None:
        return (1, LOST) if run[i] == LOST else None


STATES = [("clean", "clean"), *PAIRS, TWICE, ("lost", "lost")]


def _decoders() -> list:
    out: list = [None]
    for written, read in PAIRS:
        out.append(_Utf8(read, True) if written == "utf-8" else _Single(written, read))
    return [*out, _Twice("cp1252"), _Lost()]


def _neighbour(run: str, i: int) -> str:
    if i < 0 or i >= len(run):
        return "_"
    return run[i] if run[i] < "\x80" else "*"


def _kind(c: str) -> str:
    return c if c in "_*" else "A" if c.isupper() else "a"


def contexts(runs: Counter) -> Counter:
    """Counts of (left, character, right) over runs; non-ASCII neighbours are one class."""
    out: Counter = Counter()
    for run, n in runs.items():
        for i, c in enumerate(run):
            if c > "\x7f" and c != LOST:
                out[(_neighbour(run, i - 1), c, _neighbour(run, i + 1))] += n
    return out


class Model:
    """Clean-text likelihoods of characters in context, and the path search over them."""

    def __init__(self, counts: tuple[list, list]):
        fine, coarse = counts
        self.fine: dict = {left + c + right: n for left, c, right, n in fine}
        self.coarse: Counter = Counter()
        self.alone: Counter = Counter()
        for left, c, right, n in coarse:
            self.coarse[left + c + right] += n
            self.alone[c] += n
        self.total = max(1, sum(self.alone.values()))
        self.decoders = _decoders()
        self.scores: dict[str, float] = {}
        self.clean_runs: dict[str, bool] = {}
        self.units: dict[str, list] = {}

    def score(self, left: str, c: str, right: str) -> float:
        key = left + c + right
        found = self.scores.get(key)
        if found is None:
            n = 0.6 * self.fine.get(key, 0) + 0.3 * self.coarse[_kind(left) + c + _kind(right)] / 50 + 0.1 * self.alone[c] / 2500
            found = self.scores[key] = math.log(n / self.total + _FLOOR)
        return found

    def run_units(self, run: str) -> list:
        """For each position of a run, [(state, length, original, log likelihood)], None for ASCII.

        A run that no other state may explain has only its likelihood, in a tuple.
        """
        known = self.units.get(run)
        if known is not None:
            return known
        clean = [
            None if c < "\x80" else math.log(_FLOOR) if c == LOST else self.score(_neighbour(run, i - 1), c, _neighbour(run, i + 1))
            for i, c in enumerate(run)
        ]
        out = []
        for i, c in enumerate(run):
            if c < "\x80":
                out.append(None)
                continue
            left = _neighbour(run, i - 1)
            here = [(0, 1, c, clean[i])]
            for s, decoder in enumerate(self.decoders):
                unit = decoder.unit(run, i) if decoder else None
                if unit:
                    n, original = unit
                    likely = -1.0 if original == LOST else self.score(left, original, _neighbour(run, i + n))
                    # Worse than leaving for the clean state and coming back: on no best path.
                    if likely >= sum(x for x in clean[i : i + n] if x is not None) - ENTER - LEAVE:
                        here.append((s, n, original, likely))
            out.append(here)
        if all(here is None or len(here) == 1 for here in out):
            out = (sum(x for x in clean if x is not None),)  # the clean state only
        if len(self.units) < 20_000:
            self.units[run] = out
        return out

    def surely_clean(self, run: str) -> bool:
        """No segmentation of the run, switching free, beats the clean one."""
        known = self.clean_runs.get(run)
        if known is not None:
            return known
        units = self.run_units(run)
        if isinstance(units, tuple):
            return self.clean_runs.setdefault(run, True)
        best = [0.0] * (len(run) + 1)
        clean = 0.0
        for i in range(len(run) - 1, -1, -1):
            if units[i] is None:
                best[i] = best[i + 1]
            else:
                clean += units[i][0][3]
                best[i] = max(u[3] + best[i + u[1]] for u in units[i])
        result = best[0] <= clean + 1e-9
        if len(self.clean_runs) < 300_000:
            self.clean_runs[run] = result
        return result

    def label(self, text: str) -> list[tuple[int, int, int, str]]:
        """[(start, length, state, original)] of the damaged units on the best path; empty if clean."""
        if text.isascii():
            return []
        if all(map(self.surely_clean, set(_RUN.findall(text)))):
            return []
        # now: the best (score, back pointer) of each state that can be reached between two units.
        now: dict[int, tuple[float, int]] = {0: (0.0, -1)}
        trail: list = []
        for m in _RUN.finditer(text):
            run, start = m.group(), m.start()
            pending: dict[int, dict] = {}
            units = self.run_units(run)
            if isinstance(units, tuple):
                damaged = [value for s, value in now.items() if s]
                best = now.get(0)
                if damaged:
                    score, back = max(damaged, key=lambda value: value[0])
                    if best is None or score - LEAVE > best[0]:
                        best = (score - LEAVE, back)
                now = {0: (best[0] + units[0], best[1])}
                continue
            for i, here in enumerate(units):
                _arrive(now, pending.pop(i, None))
                if here is None:
                    continue
                clean, top = now.get(0), None
                for s, value in now.items():
                    if s and (top is None or value[0] > top[0]):
                        top = value
                for s, n, original, likely in here:
                    entry = now.get(s)
                    for source, cost in ((top, LEAVE),) if s == 0 else ((clean, ENTER), (top, SWITCH)):
                        if source is not None and (entry is None or source[0] - cost > entry[0]):
                            entry = (source[0] - cost, source[1])
                    if entry is None:
                        continue
                    back = entry[1]
                    if s:
                        trail.append((start + i, n, s, original, back))
                        back = len(trail) - 1
                    at = pending.setdefault(i + n, {})
                    if s not in at or entry[0] + likely > at[s][0]:
                        at[s] = (entry[0] + likely, back)
                now = {}
            _arrive(now, pending.pop(len(run), None))
        out = []
        at = max(now.values())[1]
        while at >= 0:
            position, n, s, original, at = trail[at]
            out.append((position, n, s, original))
        return out[::-1]


def _arrive(known: dict, more: dict | None) -> None:
    """Keeps the better value of each state."""
    for s, value in (more or {}).items():
        if s not in known or value[0] > known[s][0]:
            known[s] = value


def restore(text: str, damage: list[tuple[int, int, int, str]]) -> str:
    """The text with every damaged unit replaced by its original."""
    parts, at = [], 0
    for position, n, _, original in damage:
        parts += [text[at:position], original]
        at = position + n
    return "".join([*parts, text[at:]])


def _count_rows(counter: Counter) -> pd.DataFrame:
    rows = [(left, c, right, n) for (left, c, right), n in counter.items()]
    return pd.DataFrame(rows, columns=["left", "c", "right", "n"])


_COUNTS = "left string, c string, right string, n long"


def _kind_of(neighbour: str) -> Column:
    """``_kind`` of a column."""
    c = F.col(neighbour)
    return F.when(c.isin("_", "*"), c).when(c.rlike("^[A-Z]$"), "A").otherwise("a")


def _train(counted: DataFrame) -> tuple[list, list]:
    """The most frequent contexts, a bounded number of them, and the counts of all by character and class of neighbours.

    The classes are at most 16 for a character, so what they add is bounded by the characters there are.
    """
    summed = checkpoint(counted.groupBy("left", "c", "right").agg(F.sum("n").alias("n")))
    top = summed.orderBy(F.desc("n"), "left", "c", "right").limit(MODEL_SIZE)
    coarse = summed.groupBy(_kind_of("left").alias("left"), "c", _kind_of("right").alias("right")).agg(F.sum("n").alias("n"))
    return tuple([(r["left"], r["c"], r["right"], r["n"]) for r in df.collect()] for df in (top, coarse))


def _not_ascii(column: str) -> Column:
    """Texts in ASCII are clean, and stay in the JVM."""
    return F.col(column).rlike(r"[^\x00-\x7f]")


def train(texts: DataFrame, column: str = "text") -> tuple[list, list]:
    """Context counts of clean text: from all documents, then from those found clean."""
    only = texts.select(F.col(column).alias("text")).where(_not_ascii(column))

    def all_runs(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                seen.update(_RUN.findall(text))
            yield _count_rows(contexts(seen))

    first = _train(only.mapInPandas(all_runs, _COUNTS))

    def clean_runs(batches):
        model = Model(first)
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                if not model.label(text):
                    seen.update(_RUN.findall(text))
            yield _count_rows(contexts(seen))

    return _train(only.mapInPandas(clean_runs, _COUNTS))


def repaired(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, states, n_spans, restorable, restored) of the damaged documents only."""
    counts = train(documents, column)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        model = Model(counts)
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["key"], pdf["text"]):
                damage = model.label(text)
                if damage:
                    states = sorted({f"{STATES[s][0]} as {STATES[s][1]}" for _, _, s, _ in damage})
                    whole = restore(text, damage)
                    rows.append((k, states, len(damage), LOST not in whole, whole))
            yield pd.DataFrame(rows, columns=["key", "states", "n_units", "restorable", "restored"])

    found = documents.select(F.col(key).alias("key"), F.col(column).alias("text")).where(F.col("key").isNotNull() & _not_ascii("text"))
    return found.mapInPandas(
        run, f"key {kind}, states array<string>, n_units int, restorable boolean, restored string"
    ).withColumnRenamed("key", key)


def damage_text(text: str, written: str, read: str) -> str:
    """What ``read`` shows of text written as ``written``; for tests and round trips."""
    table = {b: c for c, b in _high_bytes(read).items()}
    data = codecs.encode(text, written, "replace")
    return "".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in data)
