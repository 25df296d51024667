"""Fuzzy search and record matching by explicit similarity: names, addresses, coverage of one list by another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bocage.functions import text
from bocage.operators import likeness
from bocage.session import checkpoint


def search_names(df: DataFrame, name: str, query: str, least: float, key: str, limit: int | None = None) -> DataFrame:
    """Rows whose name holds the query at a word similarity of at least ``least``; best, then shortest, first.

    Distinct names are scored once, so a name carried by many rows costs one comparison.
    """
    wanted = text.compare_key(F.lit(query))
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    scored = names.withColumn("similarity", text.word_similarity(wanted, text.compare_key(F.col(name)))).where(F.col("similarity") >= least)
    out = df.join(scored, name)
    return out if limit is None else out.orderBy(F.desc("similarity"), F.length(name), key).limit(limit)


def search_people(df: DataFrame, last: str, first: str | None, key: str, least: float = 0.3, limit: int = 501) -> DataFrame:
    """Rows by trigram similarity of the family name, and of the first name where one is given; best first."""

    def scored(column: str, wanted: str, out: str) -> DataFrame:
        names = df.select(column).where(F.col(column).isNotNull()).distinct()
        return names.withColumn(out, text.trigram_similarity(F.lit(wanted), F.col(column))).where(F.col(out) >= least)

    rows = df.join(scored("nom", last, "_last"), "nom")
    if first is None:
        rows = rows.withColumn("similarity", F.col("_last"))
    else:
        rows = rows.join(scored("prenom", first, "_first"), "prenom").withColumn("similarity", (F.col("_last") + F.col("_first")) / 2)
    return rows.drop("_last", "_first").orderBy(F.desc("similarity"), key).limit(limit)


def address_verdict(a: Column, b: Column) -> tuple[Column, Column]:
    """(verdict, score) of two address lines: equal, equal with abbreviations in full, or divergent."""
    left, right = text.compare_key(a), text.compare_key(b)
    verdict = (
        F.when(a.isNull() | b.isNull(), "absent")
        .when(left == right, "match")
        .when(text.expand_abbreviations(left) == text.expand_abbreviations(right), "match_after_abbreviation")
        .otherwise("divergent")
    )
    return verdict, text.dice(left, right)


_MASKS = 4


def with_pairs(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """With the letter pairs of a normalised text as a count and a bit set, computed once a row: what ``dice_bound`` reads."""
    bits = F.transform(text.numbered_pairs(F.col(column)), lambda g: F.pmod(F.xxhash64(g), F.lit(64 * _MASKS)).cast("int"))
    df = df.withColumns({f"{prefix}_n": F.greatest(F.length(column) - 1, F.lit(0)), f"{prefix}_bits": bits})

    def mask(i: int) -> Column:
        own = F.filter(f"{prefix}_bits", lambda bit: F.floor(bit / 64) == i)
        one = F.lit(1).cast("long")
        return F.aggregate(own, F.lit(0).cast("long"), lambda seen, bit: seen.bitwiseOR(F.call_function("shiftleft", one, F.pmod(bit, F.lit(64)))))

    return df.withColumns({f"{prefix}_m{i}": mask(i) for i in range(_MASKS)}).drop(f"{prefix}_bits")


def dice_bound(a: str, b: str, pa: str, pb: str) -> Column:
    """Not less than the Dice coefficient of two texts with ``with_pairs``, at the cost of a few integer operations.

    A bit set on one side only stands for at least one letter pair of that side which the other lacks.
    """

    def shared(p: str, q: str) -> Column:
        lacking = sum((F.bit_count(F.col(f"{p}_m{i}").bitwiseAND(F.bitwise_not(F.col(f"{q}_m{i}")))) for i in range(_MASKS)), F.lit(0))
        return F.col(f"{p}_n") - lacking

    na, nb = F.col(f"{pa}_n"), F.col(f"{pb}_n")
    most = F.lit(2.0) * F.least(shared(pa, pb), shared(pb, pa)) / F.nullif(na + nb, F.lit(0))
    return F.when(F.col(a) == F.col(b), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(most)


def reconciled(df: DataFrame, name_a: Column, name_b: Column, address_a: Column, address_b: Column) -> DataFrame:
    """Scores of name and address, their weighted sum, and the verdict it gives."""
    scored = df.withColumns(
        {
            "score_name": text.dice(text.compare_key(name_a), text.compare_key(name_b)),
            "score_address": text.dice(text.compare_key(address_a), text.compare_key(address_b)),
        }
    ).withColumn("_whole", F.col("score_name") * 0.5 + F.col("score_address") * 0.4)
    verdict = F.when(F.col("_whole") >= 0.8, "match").when(F.col("_whole") >= 0.5, "partial").otherwise("mismatch")
    rounded = {c: F.round(c, 3) for c in ("score_name", "score_address")}
    return scored.withColumns({**rounded, "score": F.round("_whole", 3), "verdict": verdict}).drop("_whole")


def blocked_pairs(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float) -> DataFrame:
    """Pairs of a block whose normalised texts reach a Dice coefficient.

    A bound from the letter pairs of both texts is tested first and loses nothing; what is left
    is dealt out anew, since most pairs may be of one block.  The checkpoint keeps the exact
    score from being computed before the bound.
    """
    pairs = with_pairs(left, a, "_pa").join(with_pairs(right, b, "_pb"), block).where(dice_bound(a, b, "_pa", "_pb") >= least)
    kept = pairs.select(block, *[c for c in (*left.columns, *right.columns) if c != block])
    dealt = checkpoint(kept.repartition(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.withColumn("score", text.dice(F.col(a), F.col(b))).where(F.col("score") >= least)


def dice_join(left: DataFrame, a: str, right: DataFrame, b: str, least: float) -> DataFrame:
    """(a, b, score): all pairs of distinct texts of two lists whose Dice coefficient reaches ``least``; none is lost."""
    l = checkpoint(left.select(F.col(a).alias("l")).where("l IS NOT NULL").distinct())
    r = checkpoint(right.select(F.col(b).alias("r")).where("r IS NOT NULL").distinct())
    n = likeness.blocks(l, "l")
    m = likeness.blocks(r, "r", n)

    def run(pdf):
        queries, names = pdf["l"].dropna().tolist(), pdf["r"].dropna().tolist()
        rows = []
        for i, found, scores in likeness.alike(queries, names, least):
            rows += zip([queries[i]] * len(found), (names[j] for j in found), scores)
            if len(rows) >= 50_000:
                yield pd.DataFrame(rows, columns=[a, b, "score"])
                rows = []
        yield pd.DataFrame(rows, columns=[a, b, "score"])

    dealt = lambda df, c, count: df.withColumn("block", likeness.dealt(count, c))
    return likeness.tiles(dealt(l, "l", n), dealt(r, "r", m), n, m, run, f"`{a}` string, `{b}` string, score double")


def name_verdict(queries: DataFrame, sites: DataFrame, least: float) -> DataFrame:
    """Per query: whether the sites with a name like it are none, one, of one commune, or of several.

    ``queries`` holds ``query``; ``sites`` holds ``siret``, ``commune`` and ``name``, a row a name.  The sites
    are counted where they are compared, so no pair is shuffled: a commune is in one block with all its sites,
    unless it is large or null; the sites of these are dealt out, and the large ones counted by name.
    """
    queries = checkpoint(queries.where("query IS NOT NULL").distinct())
    sites = checkpoint(sites.where("name IS NOT NULL").select("siret", "commune", "name").distinct())
    n = likeness.blocks(queries, "query")
    m = likeness.blocks(sites, "name", n)
    weight = F.greatest(F.count("*"), F.sum(F.length("name")) / likeness.LETTERS)
    loads = sites.where("commune IS NOT NULL").groupBy("commune").agg(weight.alias("load"))
    limit = loads.select(F.sum("load") / (4 * m)).first()[0] or 0.0
    large = loads.where((F.col("load") > limit) & F.lit(m > 1)).select("commune", F.lit(True).alias("large"))
    placed = sites.join(large, "commune", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    apart = F.col("large") | F.col("commune").isNull()
    placed = placed.withColumn("block", F.when(apart, likeness.dealt(m, "siret")).otherwise(likeness.dealt(m, "commune")))

    def run(pdf):
        asked, named = pdf["query"].dropna().tolist(), pdf[pdf["name"].notna()]
        site = named.groupby(["siret", "commune"], dropna=False, sort=False).ngroup().to_numpy()
        name, texts = pd.factorize(named["name"])
        # The sites of each name, one name after the other.
        order = np.argsort(name, kind="stable")
        held, begins = site[order], np.searchsorted(name[order], np.arange(len(texts) + 1))
        first = np.unique(site, return_index=True)[1]
        commune, communes = pd.factorize(named["commune"].to_numpy(dtype=object)[first])
        spread = np.zeros(len(communes), dtype=bool)
        spread[commune[commune >= 0]] = named["large"].to_numpy(dtype=bool)[first][commune >= 0]
        rows = []
        for i, found, _ in likeness.alike(asked, list(texts), least):
            of = np.unique(np.concatenate([held[begins[j] : begins[j + 1]] for j in found]))
            towns = np.unique(commune[of])
            towns = towns[towns >= 0]
            known, split = communes[towns], spread[towns]
            rows.append((asked[i], len(of), int((~split).sum()), min(known, default=None), list(known[split])))
        yield pd.DataFrame(rows, columns=["query", "n", "towns", "commune", "spread"])

    schema = "query string, n long, towns int, commune string, spread array<string>"
    n_communes = (F.sum("towns") + F.size(F.array_distinct(F.flatten(F.collect_list("spread"))))).cast("int")
    counted = likeness.tiles(queries.withColumn("block", likeness.dealt(n, "query")), placed, n, m, run, schema)
    found = counted.groupBy("query").agg(F.sum("n").alias("n_candidates"), n_communes.alias("n_communes"), F.min("commune").alias("commune"))
    one = F.col("n_communes") == 1
    return found.select(
        "query", "n_candidates", "n_communes",
        F.when(F.col("n_candidates") == 1, "unique").when(one, "one_commune").otherwise("several_communes").alias("verdict"),
        F.when(one, F.col("commune")).alias("commune"),
    )


def same_site_band(df: DataFrame, group: str, metres: str, most_m: float = 100.0, tolerance_m: float = 30.0) -> DataFrame:
    """Candidates on the site: near enough, and within the tolerance of the nearest of their group."""
    near = df.where(F.col(metres) <= most_m)
    return near.withColumn("_least", F.min(metres).over(Window.partitionBy(group))).where(F.col(metres) <= F.col("_least") + tolerance_m).drop("_least")
