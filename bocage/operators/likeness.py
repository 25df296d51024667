"""Every pair of two lists of texts by the Dice coefficient of their letter pairs, compared in numpy.

Both lists are dealt into blocks by hash and every block meets every block of the other list, each
such tile in a task of its own: no pair is left out, and no pair travels that is not alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a block: as many in large lists, and no fewer than ``LEAST`` to give every core its tiles.
BLOCK = 32_768
LEAST = 2_048
#: Letters for which a text counts as one; longer ones count as several, so blocks of long texts hold fewer.
LETTERS = 64
_WORDS = 16
#: Words of the bit sets read for every pair; the letter pairs that most texts hold are in them.
_FIRST = 4


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter pairs numbered by occurrence, as ids, most frequent first; where each text's begin; how many each has)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    n = np.maximum(lengths - 1, 0)
    begins = np.concatenate(([0], np.cumsum(n)))
    if not n.sum():
        return np.zeros(0, dtype=np.int64), begins, n
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    seen = np.zeros(int(letters.max()) + 1, dtype=bool)
    seen[letters] = True
    letters = (np.cumsum(seen) - 1)[letters]
    kinds = int(seen.sum())
    inside = np.ones(len(letters), dtype=bool)
    inside[np.cumsum(lengths)[lengths > 0] - 1] = False
    pairs = (letters * kinds + np.append(letters[1:], 0))[inside]
    owner = np.repeat(np.arange(len(texts)), n)
    key = owner * (kinds * kinds) + pairs
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    occurrence = np.empty(len(key), dtype=np.int64)
    occurrence[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    ids, counts = np.unique(pairs * (int(occurrence.max()) + 1) + occurrence, return_inverse=True, return_counts=True)[1:]
    place = np.empty(len(counts), dtype=np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return place[ids], begins, n


def _bit_sets(ids: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit sets of the ids, a row a word; ids beyond the bits share them."""
    out = np.empty((_WORDS, len(n)), dtype=np.uint64)
    for i in range(0, len(n), 4_096):
        j = min(i + 4_096, len(n))
        held = np.zeros((j - i, _WORDS * 64), dtype=np.uint8)
        held[np.repeat(np.arange(j - i), n[i:j]), ids[begins[i] : begins[j]] % (_WORDS * 64)] = 1
        out[:, i:j] = np.packbits(held, axis=1).view(np.uint64).T
    return out


def alike(queries: list[str], names: list[str], least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, names, scores), by place, of the names whose Dice coefficient with the query reaches ``least``, if any.

    Equal texts score 1, others of less than two letters 0.  A bit set in the query alone stands for a
    letter pair at least which the name lacks; what that leaves is scored by the letter pairs themselves.
    """
    ids, begins, n = _encoded([*queries, *names])
    bits, k = _bit_sets(ids, begins, n), len(queries)
    marked = np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool)
    exact = len(marked) <= _WORDS * 64
    by_length = np.argsort(n[k:], kind="stable")
    b, nb = np.ascontiguousarray(bits[:, k:][:, by_length]), n[k:][by_length]
    # What a text holds besides the bits of the first words, and besides all of them.
    rest = n - np.bitwise_count(bits[:_FIRST]).sum(0, dtype=np.int64)
    over = n - np.bitwise_count(bits).sum(0, dtype=np.int64)
    rest_b, over_b = rest[k:][by_length], over[k:][by_length]
    short: dict[str, list[int]] = {}
    for j in by_length[: np.searchsorted(nb, 1)]:
        short.setdefault(names[j], []).append(j)
    span = met = held = None
    for i in np.lexsort((rest[:k], n[:k])):
        if not n[i]:
            if queries[i] in short:
                yield int(i), np.array(short[queries[i]]), np.ones(len(short[queries[i]]))
            continue
        if span is None or span[0] != n[i]:
            low = np.searchsorted(nb, max(1, n[i] * least / (2 - least) - 1e-9))
            high = np.searchsorted(nb, n[i] * (2 - least) / least + 1e-9, side="right")
            span, needed = (n[i], None), np.ceil(least / 2 * (n[i] + nb[low:high]) - 1e-9).astype(np.int32)
            met, held = np.empty(high - low, dtype=np.uint64), np.empty(high - low, dtype=np.uint8)
            shared = np.empty(high - low, dtype=np.int16)
        if span[1] != rest[i]:
            span, least_first = (n[i], rest[i]), np.clip(needed - np.minimum(rest[i], rest_b[low:high]), -1, 2_000).astype(np.int16)
        shared[:] = 0
        for w in range(_FIRST):
            np.bitwise_and(b[w, low:high], bits[w, i], out=met)
            np.bitwise_count(met, out=held)
            np.add(shared, held, out=shared)
        near = np.flatnonzero(shared >= least_first)
        if not len(near):
            continue
        at = near + low
        common = np.bitwise_count(b[:, at] & bits[:, i, None]).sum(0, dtype=np.int64)
        kept = common + np.minimum(over[i], over_b[at]) >= needed[near]
        at, common = at[kept], common[kept]
        if not exact and len(at):
            own = ids[begins[i] : begins[i + 1]]
            marked[own] = True
            places = by_length[at] + k
            common = np.array([np.count_nonzero(marked[ids[begins[j] : begins[j + 1]]]) for j in places])
            marked[own] = False
        scores = 2.0 * common / (n[i] + nb[at])
        kept = scores >= least
        if kept.any():
            yield int(i), by_length[at[kept]], scores[kept]


def blocks(df: DataFrame, text: str, other: int = 1) -> int:
    """Blocks of a list, by its letters; of a small one as many as keep the cores busy, where the other list has ``other``."""
    rows, letters = df.agg(F.count(text), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    weight = max(rows, letters // LETTERS)
    return max(1, -(-weight // BLOCK), min(-(-weight // LEAST), -(-3 * df.sparkSession.sparkContext.defaultParallelism // other)))


def dealt(n: int, *by: str) -> Column:
    """The block, of ``n``, of a row."""
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def tiles(left: DataFrame, right: DataFrame, n: int, m: int, run: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` over every one of ``n`` blocks (column ``block``) of the left list with every one of ``m`` of the right.

    It gets the rows of both in one frame, the columns of the other list null.
    """
    numbers = lambda count, tile: F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), tile))
    a = left.withColumn("tile", numbers(m, lambda j: F.col("block") * m + j)).drop("block")
    b = right.withColumn("tile", numbers(n, lambda i: i * m + F.col("block"))).drop("block")

    def each(batches):
        whole = list(batches)
        if whole:
            for _, pdf in pd.concat(whole).groupby("tile"):
                yield from run(pdf)

    return a.unionByName(b, allowMissingColumns=True).repartitionById(n * m, F.col("tile")).mapInPandas(each, schema)
