"""Problem 1: matching centres and establishments that share no key.

Probabilistic record linkage.  Candidate pairs come from several blocking passes; each pair
becomes a pattern of agreement levels; expectation-maximisation over the counts of the
patterns estimates how often each level occurs among matches and among non-matches; the
posterior of a pair's pattern is its confidence.  Pairs are then accepted where they are
the best of both sides and their posterior reaches the threshold; no level excludes a pair by itself.

Blocks are whole words, any of a name or a street word at its door, in every spelling the other
table knows.  All pairs of a block are compared, however large it is; large ones are dealt out in tiles.

Only patterns and their counts, at most the product of the level counts, reach the driver.

Defined results: rows without key take no part; of several rows of one key the latest
counts, on a tie the greatest by content.  Null or blank names, streets and towns are
levels of their own ("not shown"), never agreement.  Closed establishments are no
candidates.  Records whose commune cannot be resolved are not blocked, hence unmatched.
Empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bocage.llm.addresses import Address, parse_address, same_place, same_street
from bocage.llm.names import HEALTH_CENTRE, Name, name_overlap, parse_name, trades_agree
from bocage.llm.spelling import similar_words
from bocage.operators.communes import with_commune
from bocage.session import checkpoint

THRESHOLD = 0.5
NEIGHBOUR_DOORS = 6
#: Levels of each comparison, worst first; 0 conflict, 1 not shown.
LEVELS = {"name": 5, "trade": 3, "street": 3, "number": 4}
_BLOCK_SCHEMA = "key string, commune string, rec string, blocks array<struct<kind:string,word:string>>"
#: Pairs of one block from which it is dealt out, in tiles of about as many.
LARGE_BLOCK = 20_000
#: How often, at most, one comparison of two records of the same site conflicts: the errors the registers are taken to have.
CONFLICT = 0.001


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the latest, on a tie the greatest by content.  Combines before the shuffle."""
    named = df.where(F.col(key).isNotNull())
    columns = [f"`{c}`" for c in named.columns]
    best = named.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.struct(F.col(order).alias("_at"), F.xxhash64(*columns).alias("_tie"), F.struct(*columns).alias("_row"))).alias("_last")
    )
    return best.select("_last._row.*")


def _encode(name: list[Name], address: Address, postal: str) -> str:
    """Parsed parts of a record as one compact text that travels with its blocks."""
    names = "\x1e".join(
        "\x1f".join((",".join(sorted(n.trades)), n.form, " ".join(n.words), " ".join(n.initials))) for n in name
    )
    return "\x1d".join(
        (names, str(address.number), address.suffix, address.street_type, " ".join(address.words), address.place, postal)
    )


@lru_cache(maxsize=20_000)
def _decode(text: str) -> tuple[list[Name], Address, str]:
    names, number, suffix, kind, words, place, postal = text.split("\x1d")
    out = []
    for part in names.split("\x1e") if names else []:
        trades, form, ws, initials = part.split("\x1f")
        out.append(Name(frozenset(trades.split(",")) - {""}, form, tuple(ws.split()), tuple(initials.split()), False))
    return out, Address(int(number), suffix, kind, tuple(words.split()), place), postal


def _blocks(names: list[Name], address: Address) -> list[tuple[str, str]]:
    """Blocking passes as (kind, word): words of the names, street words at the door, the door where no street is shown, the named place."""
    out = {("h", w) for n in names for w in n.words}
    out |= {(f"a{address.number}", w) for w in address.words if len(w) > 1}
    if address.number >= 0 and not address.words:
        out.add(("n", str(address.number)))
    if address.place:
        out.add(("p", address.place))
    return sorted(out)


def _prepared(kind: str):
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if kind == "centre":
                    name = parse_name(r.name1, r.town)
                    # A name that shows no trade is still that of a health centre.
                    names = [name if name.trades else name._replace(trades=HEALTH_CENTRE, form="c")]
                    address = parse_address(r.street1, r.street2, r.street3)
                else:
                    legal = parse_name(r.name1, r.town)
                    # A trade name without a trade of its own has that of its legal unit.
                    names = [legal]
                    for text in (r.name2, r.name3):
                        n = parse_name(text, r.town)
                        if n.words:
                            names.append(n if n.trades else n._replace(trades=legal.trades, form=legal.form))
                    address = parse_address(" ".join(x for x in (r.street1, r.street2, r.street3) if x))
                blocks = [{"kind": k, "word": w} for k, w in _blocks(names, address)]
                rows.append((r.key, r.commune, _encode(names, address, r.postal or ""), blocks))
            yield pd.DataFrame(rows, columns=["key", "commune", "rec", "blocks"])

    return run


def prepare(
    df: DataFrame, communes: DataFrame, kind: str, key: str, names: list[Column], streets: list[Column],
    code: Column, postal: Column, town: Column,
) -> DataFrame:
    """Records parsed once: key, commune, encoded parts and block keys."""
    three = lambda cols: [*cols, *[F.lit(None).cast("string")] * (3 - len(cols))]
    flat = df.select(
        F.col(key).cast("string").alias("key"), postal.alias("postal"), town.alias("town"), code.alias("code"),
        *(c.alias(f"name{i}") for i, c in enumerate(three(names), 1)),
        *(c.alias(f"street{i}") for i, c in enumerate(three(streets), 1)),
    )
    placed = with_commune(flat, communes, F.col("code"), F.col("postal"), F.col("town"))
    return placed.where(F.col("commune").isNotNull()).mapInPandas(_prepared(kind), _BLOCK_SCHEMA)


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs that share a block of their commune in any pass."""

    def keyed(df: DataFrame, side: str) -> DataFrame:
        blocks = df.select("commune", F.col("key").alias(side), F.explode("blocks").alias("b"))
        return blocks.select("commune", F.col("b.kind").alias("kind"), F.col("b.word").alias("word"), side)

    a, b = keyed(left, "l"), keyed(right, "r")
    # Any of several words of a name may meet, so one error in each is allowed for; a street has often one word only.
    words = lambda df, named: df.where((F.col("kind") == "h") if named else F.col("kind").startswith("a")).select("word").distinct()
    spelt = similar_words(words(a, True), words(b, True), 1).unionByName(similar_words(words(a, False), words(b, False)))
    spelt = checkpoint(spelt.distinct())
    b = b.join(spelt, F.col("word") == F.col("b")).select("commune", "kind", F.col("a").alias("word"), "r").unionByName(b)
    block = F.xxhash64("commune", "kind", "word").alias("block")
    a, b = a.select(block, "l"), b.select(block, "r").distinct()
    sizes = a.groupBy("block").agg(F.count("*").alias("nl")).join(b.groupBy("block").agg(F.count("*").alias("nr")), "block")
    large = checkpoint(sizes.where(F.col("nl") * F.col("nr") > LARGE_BLOCK))
    small = a.join(b, "block").join(large, "block", "left_anti").select("l", "r")
    # A large block is a grid: each row is in one strip of its side and meets all strips of the other.
    strips = lambda n: F.ceil(F.col(n) / LARGE_BLOCK**0.5).cast("int")
    own = lambda side, n: F.pmod(F.xxhash64(side), strips(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), strips(n) - 1))
    l = a.join(large, "block").select("block", "l", own("l", "nl").alias("i"), every("nr").alias("j"))
    r = b.join(large, "block").select("block", "r", every("nl").alias("i"), own("r", "nr").alias("j"))
    pairs = small.unionByName(l.join(r, ["block", "i", "j"]).select("l", "r")).distinct()
    return pairs.join(left.select(F.col("key").alias("l"), F.col("rec").alias("l_rec")), "l").join(
        right.select(F.col("key").alias("r"), F.col("rec").alias("r_rec")), "r"
    )


def compare(a: tuple, b: tuple) -> tuple[int, int, int, int, int]:
    """Agreement levels (name, trade, street, number) and a finer rank for ties."""
    (names_a, addr_a, postal_a), (names_b, addr_b, postal_b) = a, b
    na = names_a[0] if names_a else Name(frozenset(), "", (), (), False)
    legal = names_b[0] if names_b else na
    name, rank = 0, 0
    if not na.words:
        name = 1
    else:
        for nb in names_b:
            hits, only_a, only_b = name_overlap(na.words, nb.words)
            if hits:
                initials = sum(any(w.startswith(i) for w in nb.words) for i in na.initials)
                level = 4 if not only_a and not only_b else 3 if not only_a or not only_b else 2
                name, rank = max((name, rank), (level, hits * 4 - only_a - only_b + initials))
    trade = trades_agree(na, legal) + 1
    if not addr_a.words or not addr_b.words:
        street = 2 if same_place(addr_a.place, addr_b.place) else 1
    else:
        street = 2 if same_street(addr_a.street_type, addr_a.words, addr_b.street_type, addr_b.words) else 0
    if addr_a.number < 0 or addr_b.number < 0:
        number = 1
    elif addr_a.number == addr_b.number:
        number = 3
        rank += addr_a.suffix == addr_b.suffix
    else:
        number = 2 if abs(addr_a.number - addr_b.number) <= NEIGHBOUR_DOORS else 0
    rank = rank * 2 + (postal_a == postal_b and postal_a != "") + 2 * (number == 3)
    return name, trade, street, number, rank


def _compared(batches):
    for pdf in batches:
        rows = [(a, b, *compare(_decode(x), _decode(y))) for a, b, x, y in zip(pdf["l"], pdf["r"], pdf["l_rec"], pdf["r_rec"])]
        yield pd.DataFrame(rows, columns=["l", "r", *LEVELS, "rank"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior match probability of each pattern, by expectation-maximisation.

    Comparisons are taken as independent given the class.  Among matches a conflict, level 0, is
    held to at most ``CONFLICT`` in each comparison: that is what tells the classes apart, so they
    cannot swap, and a perfect name alone does not outweigh another street.
    """
    if not len(counts):
        return np.zeros(0)
    sizes = list(LEVELS.values())
    prior = 0.1
    m = [np.linspace(1, 12, k) ** 2 / (np.linspace(1, 12, k) ** 2).sum() for k in sizes]
    u = [np.linspace(12, 1, k) ** 2 / (np.linspace(12, 1, k) ** 2).sum() for k in sizes]
    weight = counts / counts.sum()
    post = np.zeros(len(counts))
    for _ in range(rounds):
        lm = np.log(prior) + sum(np.log(m[j][patterns[:, j]]) for j in range(len(sizes)))
        lu = np.log1p(-prior) + sum(np.log(u[j][patterns[:, j]]) for j in range(len(sizes)))
        new = 1 / (1 + np.exp(np.clip(lu - lm, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        prior = float(np.clip((weight * post).sum(), 1e-6, 0.5))
        for j, k in enumerate(sizes):
            for table, w in ((m, weight * post), (u, weight * (1 - post))):
                t = np.bincount(patterns[:, j], weights=w, minlength=k) + 1e-6
                table[j] = t / t.sum()
            if m[j][0] > CONFLICT:
                m[j][1:] *= (1 - CONFLICT) / m[j][1:].sum()
                m[j][0] = CONFLICT
        if done:
            break
    return post


def link(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(l, r, confidence): pairs that are the best of both sides and reach the threshold."""
    # Parsed once: the blocks and the comparison both read the records.
    left, right = checkpoint(left), checkpoint(right)
    scored = candidate_pairs(left, right).mapInPandas(
        _compared, "l string, r string, name int, trade int, street int, number int, rank int"
    )
    scored = checkpoint(scored)
    table = scored.groupBy(*LEVELS).count().collect()  # at most the product of the level counts
    patterns = np.array([[r[c] for c in LEVELS] for r in table], dtype=int).reshape(-1, len(LEVELS))
    posterior = estimate(patterns, np.array([r["count"] for r in table], dtype=float))
    confidence = F.lit(0.0)
    for row, p in zip(patterns, posterior):
        same = F.lit(True)
        for c, level in zip(LEVELS, row):
            same = same & (F.col(c) == int(level))
        confidence = F.when(same, float(p)).otherwise(confidence)
    judged = scored.withColumn("confidence", confidence).where(F.col("confidence") >= threshold)
    order = [F.desc("confidence"), F.desc("rank")]
    best = judged.withColumn("best_l", F.rank().over(Window.partitionBy("l").orderBy(*order, "r"))).withColumn(
        "best_r", F.rank().over(Window.partitionBy("r").orderBy(*order, "l"))
    )
    return best.where((F.col("best_l") == 1) & (F.col("best_r") == 1)).select("l", "r", "confidence", *LEVELS)
