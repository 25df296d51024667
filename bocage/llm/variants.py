"""Problem 4: variant spellings of organisation names.

Names become canonical strings (trade words, legal forms, order and initials set aside).
Within a trade of a commune (different trades are infinitely far apart, which is a metric too)
the strings form a metric space under the edit distance: every string of the register goes to the cell of its nearest pivot, every typed string to all cells that the
triangle inequality cannot rule out for the radius, and each cell runs an exact radius join.
Candidates are then judged by trade, completeness and the address of the row.

Pivots are drawn by hash at a rate of one over the square root of the commune's strings, so
the cells stay of that size at any scale and no step is quadratic.  Cells hold distinct
strings, not rows: a name typed a million times is compared once.

Defined results: null, blank or sentinel names and rows whose commune cannot be resolved link
to nothing; of several rows of one siret the latest counts; repeated rows give one link; a row
whose best two legal units cannot be told apart gives none; empty tables give none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bocage.llm.addresses import parse_address, same_street
from bocage.llm.linkage import latest
from bocage.llm.names import COMMON, Name, name_overlap, parse_name, trades_agree, variants
from bocage.llm.spelling import edits, same_word
from bocage.operators.communes import with_commune
from bocage.session import checkpoint

RADIUS = 2
MOST_COST = 2.75
#: Trade of the typed names that show none: they meet every trade of their commune.
ANY = "*"
_UNIT_SCHEMA = "siren string, commune string, trade string, variant string, profile string"
_TYPED_SCHEMA = "id long, commune string, trade string, variant string, profile string"


def _profile(n: Name, address) -> str:
    return "\x1d".join(
        (
            ",".join(sorted(n.trades)), n.form, " ".join(n.words), " ".join(n.initials), "1" if n.doctor else "", n.legal, n.last,
            str(address.number), address.street_type, " ".join(address.words),
        )
    )


def _read(profile: str):
    trades, form, words, initials, doctor, legal, last, number, kind, street = profile.split("\x1d")
    name = Name(frozenset(trades.split(",")) - {""}, form, tuple(words.split()), tuple(initials.split()), doctor == "1", legal, last)
    return name, (int(number), kind, tuple(street.split()))


def _register(batches):
    """Every variant of every name of an establishment; a trade name takes its legal unit's trade."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            legal = parse_name(r.legal, r.town)
            address = parse_address(" ".join(x for x in (r.s1, r.s2, r.s3) if x))
            for text in dict.fromkeys((r.legal, r.n2, r.n3)):
                n = parse_name(text, r.town)
                own = legal.doctor and any(same_word(legal.last, w) for w in n.words)
                n = n._replace(trades=legal.trades, form=legal.form, doctor=own, legal=legal.legal, last=legal.last)
                profile = _profile(n, address)
                for v, _ in variants(n):
                    rows += [(r.siren, r.commune, t, v, profile) for t in sorted(legal.trades) or [""]]
        yield pd.DataFrame(rows, columns=["siren", "commune", "trade", "variant", "profile"])


def _typed(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            n = parse_name(r.name, r.town)
            trades, profile = [*sorted(n.trades), ""] if n.trades else [ANY], _profile(n, parse_address(r.street))
            for v, _ in variants(n):
                rows += [(r.id, r.commune, t, v, profile) for t in trades]
        yield pd.DataFrame(rows, columns=["id", "commune", "trade", "variant", "profile"])


def register_names(sites: DataFrame, communes: DataFrame) -> DataFrame:
    """Variants of the names of all legal units, by commune."""
    flat = latest(sites, "siret", "date_maj").where(F.col("siren").isNotNull()).select(
        F.col("siren").cast("string").alias("siren"), F.col("raison_sociale_unite_legale").alias("legal"),
        F.col("denomination_usuelle").alias("n2"), F.col("enseigne").alias("n3"), F.col("libelle_commune").alias("town"),
        F.col("numero_voie").alias("s1"), F.col("type_voie").alias("s2"), F.col("libelle_voie").alias("s3"),
        F.col("code_commune").alias("code"), F.col("code_postal").alias("postal"),
    )
    placed = with_commune(flat, communes, F.col("code"), F.col("postal"), F.col("town"))
    return placed.where(F.col("commune").isNotNull()).mapInPandas(_register, _UNIT_SCHEMA).distinct()


def typed_names(rows: DataFrame, communes: DataFrame) -> DataFrame:
    """Variants of the names typed in the directory, by commune; rows without a name are left out early."""
    named = rows.where(F.col("id").isNotNull() & (F.trim("raison_sociale") != ""))
    flat = named.select(
        "id", F.col("raison_sociale").alias("name"), F.col("ville").alias("town"), F.col("adresse").alias("street"),
        F.col("code_insee").alias("code"), F.col("code_postal").alias("postal"),
    ).distinct()
    placed = with_commune(flat, communes, F.col("code"), F.col("postal"), F.col("town"))
    return placed.where(F.col("commune").isNotNull()).mapInPandas(_typed, _TYPED_SCHEMA)


def radius_pairs(register: DataFrame, typed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(commune, variant, known, distance): all pairs of strings of a commune at most ``radius`` edits apart.

    Both inputs are distinct (commune, variant).  Levenshtein distance is a metric, so with
    p the nearest pivot of q and any s within r of q, d(q, p_s) <= d(q, p) + 2r: replicating
    q to the pivots within that bound loses no pair.  Cells are cut further by length, and a cell
    is visited only where its own annulus is within reach.
    """
    sizes = register.groupBy("commune").agg(F.count("*").alias("n"), F.min_by("variant", F.xxhash64("variant")).alias("first"))
    share = F.pmod(F.xxhash64("variant", F.lit(7)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    pivots = register.join(sizes, "commune").where((share < 1 / F.sqrt("n")) | (F.col("variant") == F.col("first"))).select(
        "commune", F.col("variant").alias("pivot")
    )
    # One row of pivots for each commune, about the square root of its names: names meet them row by
    # row, so a commune with a third of all names is split among tasks like any other large side.
    sets = pivots.groupBy("commune").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))
    distances = F.transform("pivots", lambda p: F.struct(F.levenshtein("variant", p).alias("d"), p.alias("pivot"))).alias("to")
    homes = register.join(sets, "commune").select("commune", "variant", distances).select("commune", "variant", F.array_min("to").alias("h"))
    homes = homes.select("commune", F.col("variant").alias("known"), F.col("h.pivot").alias("pivot"), F.col("h.d").alias("known_d"))
    # A cell is a pivot and a band of lengths, as strings within the radius differ in length by no more than it.
    width = 2 * radius + 1
    homes = checkpoint(homes.withColumn("band", F.floor(F.length("known") / width)))
    # Each cell's own annulus: a name farther inside or outside than the radius visits it for nothing.
    cells = homes.groupBy("commune", "pivot", "band").agg(F.min("known_d").alias("inner"), F.max("known_d").alias("outer"))
    reach = typed.join(sets, "commune").select("commune", "variant", distances)
    reach = reach.select("commune", "variant", "to", (F.array_min("to")["d"] + 2 * radius).alias("most"))
    near = F.explode(F.filter("to", lambda x: x["d"] <= F.col("most"))).alias("x")
    visits = reach.select("commune", "variant", near).select("commune", "variant", F.col("x.pivot").alias("pivot"), F.col("x.d").alias("typed_d"))
    bands = F.sequence(F.floor((F.length("variant") - radius) / width), F.floor((F.length("variant") + radius) / width))
    visits = visits.select("*", F.explode(bands).alias("band")).join(cells, ["commune", "pivot", "band"])
    visits = visits.where(F.col("typed_d").between(F.col("inner") - radius, F.col("outer") + radius)).drop("inner", "outer")
    # The annulus and the length are necessary conditions, cheaper than the distance itself.
    annulus = F.abs(F.col("known_d") - F.col("typed_d")) <= radius
    length = F.abs(F.length("known") - F.length("variant")) <= radius
    met = visits.join(homes, ["commune", "pivot", "band"]).where(annulus & length)
    close = met.withColumn("distance", F.levenshtein("variant", "known", radius)).where(F.col("distance") >= 0)
    return close.select("commune", "variant", "known", "distance")


def link_cost(a: Name, place_a, b: Name, place_b) -> float:
    """How far a typed name is from a registered one; above ``MOST_COST`` they are two organisations."""
    trade = trades_agree(a, b)
    if trade < 0:
        return 99.0
    hits, only_a, only_b = name_overlap(a.words, b.words)
    common_a = sorted(w for w in a.words if w in COMMON)
    common_b = sorted(w for w in b.words if w in COMMON)
    if not hits:
        return 99.0
    if b.doctor:
        # The surname must be there; a given name may be missing or short, not another one.
        if not any(same_word(b.last, w) for w in a.words):
            return 99.0
        rest = [w for w in b.words if w != b.last]
        strange = [w for w in a.words if w not in COMMON and not same_word(w, b.last) and not any(same_word(w, v) for v in rest)]
        if any(len(w) > 6 or not any(w[:2] == v[:2] for v in rest) for w in strange):
            return 99.0
        cost = 0.5 * bool(only_b)
    elif only_a:
        return 99.0
    else:
        cost = 1.5 * only_b
    # Different kinds of name (val, pays, saint, numbers) around one word are different names.
    missing = [w for w in common_b if w not in common_a]
    extra = [w for w in common_a if w not in common_b]
    cost += 3.0 * len(extra) + 1.0 * len(missing)
    if extra and missing:
        return 99.0
    cost += 0.5 * (trade == 0)
    cost += 2.0 * bool(a.legal and b.legal and a.legal != b.legal)
    for w in a.words:
        if w not in COMMON and w not in b.words:
            cost += 0.5 * min(2, min(edits(w, v, 2) for v in b.words))
    for i in a.initials:
        cost += 0.0 if any(w.startswith(i) for w in b.words) else 0.25
    number_a, kind_a, street_a = place_a
    number_b, kind_b, street_b = place_b
    if number_a == number_b and number_a >= 0 and same_street(kind_a, street_a, kind_b, street_b):
        cost -= 1.0
    return cost


def _judged(batches):
    for pdf in batches:
        costs = [link_cost(*_read(a), *_read(b)) for a, b in zip(pdf["a"], pdf["b"])]
        out = pdf.assign(cost=costs)
        yield out.loc[out["cost"] <= MOST_COST, ["a_id", "commune", "siren", "cost"]]


def link_names(register: DataFrame, typed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, siren, cost): the one legal unit of the row's commune that its name stands for."""
    # Profiles travel as hashes within their commune; their texts join only the pairs to be judged.
    register = checkpoint(register.select("*", F.xxhash64("profile").alias("b_id")))
    typed = checkpoint(typed.select("*", F.xxhash64("profile").alias("a_id")))
    space = F.concat_ws("|", "commune", "trade")
    known = register.select("commune", space.alias("space"), "siren", F.col("variant").alias("known"), "b_id")
    # A name that shows no trade may belong to any of the few there are in its commune.
    spaces = known.select("commune", "space").distinct()
    profiles = typed.select("commune", "trade", "variant", "a_id").distinct()
    plain = profiles.where(F.col("trade") != ANY).select("commune", space.alias("space"), "variant", "a_id")
    every = profiles.where(F.col("trade") == ANY).join(spaces, "commune").select("commune", "space", "variant", "a_id")
    wanted = plain.unionByName(every)
    pairs = radius_pairs(
        known.select(F.col("space").alias("commune"), F.col("known").alias("variant")).distinct(),
        wanted.select(F.col("space").alias("commune"), "variant").distinct(),
        radius,
    ).withColumnRenamed("commune", "space")
    # Equal profiles are judged once, however many rows carry them.
    units = known.select("space", "known", "siren", "b_id")
    met = wanted.join(pairs, ["space", "variant"]).join(units, ["space", "known"]).select("commune", "a_id", "siren", "b_id").distinct()
    texts = lambda df, c: df.select("commune", f"{c}_id", F.col("profile").alias(c)).dropDuplicates(["commune", f"{c}_id"])
    candidates = met.join(texts(typed, "a"), ["commune", "a_id"]).join(texts(register, "b"), ["commune", "b_id"])
    judged = candidates.select("commune", "a_id", "a", "siren", "b").mapInPandas(_judged, "a_id long, commune string, siren string, cost double")
    best = judged.groupBy("commune", "a_id", "siren").agg(F.min("cost").alias("cost"))
    order = Window.partitionBy("commune", "a_id").orderBy("cost")
    ranked = best.withColumn("rank", F.rank().over(order)).where("rank = 1")
    lone = ranked.groupBy("commune", "a_id").agg(F.count("*").alias("n"), F.min("siren").alias("siren"), F.min("cost").alias("cost")).where("n = 1")
    rows = typed.select("id", "commune", "a_id").distinct()
    return rows.join(lone, ["commune", "a_id"]).select("id", "siren", "cost").distinct()
