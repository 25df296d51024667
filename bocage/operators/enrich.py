"""Joins that enrich or compare tables: cascades, carry-over, caches, differences, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.functions import geo


def star(base: DataFrame, key: str, *attributes: DataFrame) -> DataFrame:
    """A base table with the attributes of others on one key; rows without attributes stay."""
    out = base
    for attribute in attributes:
        out = out.join(attribute, key, "left")
    return out


def with_visited(rows: DataFrame, reference: DataFrame, key: str, value: str, found: str, missing: str) -> DataFrame:
    """Foreign-key enrichment that marks every row it looked at as found or missing."""
    named = reference.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_hit"))
    joined = rows.join(named, rows[key] == named["_key"], "left")
    return joined.withColumns(
        {value: F.col("_value"), "provenance": F.when(F.col("_hit"), found).otherwise(missing)}
    ).drop("_key", "_value", "_hit")


def through_cache(rows: DataFrame, key: Column, cache: DataFrame, cache_key: str, accepted: Column, values: Sequence[str]) -> DataFrame:
    """Rows with the values an accepted cache entry holds for their computed key, else null."""
    usable = cache.where(accepted).select(F.col(cache_key).alias("_key"), *values)
    keyed = rows.withColumn("_lookup", key)
    return keyed.join(usable, keyed["_lookup"] == usable["_key"], "left").drop("_lookup", "_key")


def carried_over(new: DataFrame, old: DataFrame, key: str | Sequence[str], value: str, provenance: str, label: str) -> DataFrame:
    """Missing values taken from the previous generation where all keys are equal, marked so; own values stay."""
    keys = [key] if isinstance(key, str) else list(key)
    before = old.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(value).alias("_old"))
    joined = new.join(before, [new[k] == before[f"_key_{k}"] for k in keys], "left")
    taken = F.col(value).isNull() & F.col("_old").isNotNull()
    return joined.withColumns(
        {provenance: F.when(taken, label).otherwise(F.col(provenance)), value: F.coalesce(F.col(value), F.col("_old"))}
    ).drop(*[f"_key_{k}" for k in keys], "_old")


def missing_from(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys a table lacks: the canary, and added or removed rows."""
    return keys.select(key).distinct().join(table.select(key), key, "left_anti")


def generation_diff(new: DataFrame, old: DataFrame, key: str, moved_m: float) -> DataFrame:
    """One row of counts: keys added, removed, kept, that lost their point, and that moved too far."""
    a = new.groupBy(F.col(key).alias("k")).agg(F.max(F.struct("lon", "lat")).alias("n"))
    b = old.groupBy(F.col(key).alias("k")).agg(F.max(F.struct("lon", "lat")).alias("o"))
    both = a.withColumn("in_new", F.lit(1)).join(b.withColumn("in_old", F.lit(1)), "k", "full")
    far = geo.haversine_m(F.col("n.lon"), F.col("n.lat"), F.col("o.lon"), F.col("o.lat")) > moved_m
    return both.agg(
        F.count_if(F.col("in_old").isNull()).alias("added"), F.count_if(F.col("in_new").isNull()).alias("removed"),
        F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).alias("kept"),
        F.count_if(F.col("o.lon").isNotNull() & F.col("n.lon").isNull() & F.col("in_new").isNotNull()).alias("lost_point"),
        F.count_if(far).alias("moved"),
    )


def upserted(base: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Base rows replaced or joined by the latest change of their key."""
    rows = base.withColumn("_write", F.lit(0)).unionByName(changes.withColumn("_write", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "_write"]
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
        F.max_by(F.struct(*columns), F.struct("_write", order)).alias("_row")
    )
    return best.select("_row.*")


def merged_candidates(known: DataFrame, offers: DataFrame, key: str, score: str, least: float, fields: Sequence[str]) -> DataFrame:
    """Known candidates with fields filled from offers, plus new ones whose score reaches the least."""
    k = known.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_k_{f}") for f in [*fields, score]], F.lit(True).alias("_known"))
    joined = k.join(offers.select(key, score, *fields), k["_k"] == offers[key], "full")
    kept = joined.where(F.col("_known") | (F.col(score) >= least))
    return kept.select(
        F.coalesce("_k", key).alias(key), F.coalesce(F.col(score), F.col(f"_k_{score}")).alias(score),
        *[F.coalesce(F.col(f), F.col(f"_k_{f}")).alias(f) for f in fields],
    )


def matched_one_to_one(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Greedy matching by score, then keys: each pair is taken if neither side is; null keys and scores take no part."""
    kept = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    keyed = kept.select(left, right, score, F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
    return matched_groups(keyed.select("a", "b", score), keyed.select("a", left).distinct(), keyed.select("b", right).distinct(), left, right, score)


def matched_groups(edges: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The same over groups of equal keys: ``edges`` (a, b, score) relates groups, ``lefts`` (a, left) and ``rights``
    (b, right) hold their members, of one group or several.

    The pairs of two groups are never written out, and ties need no rounds: the groups that are
    linked, by an edge or a member, are matched together, one such component after the other.
    """
    from bocage.session import checkpoint, ship_package

    ship_package(edges.sparkSession)
    edges = checkpoint(edges.where(F.col(score).isNotNull()).groupBy("a", "b").agg(F.max(score).alias(score)))
    lefts = checkpoint(lefts.join(edges.select("a").distinct(), "a", "left_semi").distinct())
    rights = checkpoint(rights.join(edges.select("b").distinct(), "b", "left_semi").distinct())
    node = lambda kind, name: F.concat(F.lit(kind), F.col(name))

    def shared(members: DataFrame, group: str, key: str) -> DataFrame:
        first = members.groupBy(key).agg(F.min(group).alias("first"), F.count("*").alias("n")).where("n > 1")
        return members.join(first, key).select(node(group, group).alias("u"), node(group, "first").alias("v"))

    links = edges.select(node("a", "a").alias("u"), node("b", "b").alias("v"))
    roots = components(links.unionByName(shared(lefts, "a", left)).unionByName(shared(rights, "b", right)))
    rows = (
        edges.withColumn("node", node("a", "a"))
        .unionByName(lefts.withColumn("node", node("a", "a")), allowMissingColumns=True)
        .unionByName(rights.withColumn("node", node("b", "b")), allowMissingColumns=True)
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def greedy(table):
        import pyarrow as pa

        levels: dict = {}
        members: dict = {}
        for row in table.select(["a", "b", left, right, score]).to_pylist():
            if row[score] is not None:
                levels.setdefault(row[score], []).append((row["a"], row["b"]))
            elif row["b"] is None:
                members.setdefault(("a", row["a"]), []).append(row[left])
            else:
                members.setdefault(("b", row["b"]), []).append(row[right])
        for keys in members.values():
            keys.sort()
        at, gone, used, out = {}, set(), set(), []
        for level in sorted(levels, reverse=True):
            offers: dict = {}
            for a, b in levels[level]:
                members["a", a] = free = [k for k in members["a", a] if k not in gone]
                for key in free:
                    offers.setdefault(key, []).append(b)
            for key in sorted(offers):
                best = None
                for b in offers[key]:
                    keys, i = members["b", b], at.get(b, 0)
                    while i < len(keys) and keys[i] in used:
                        i += 1
                    at[b] = i
                    if i < len(keys) and (best is None or keys[i] < best):
                        best = keys[i]
                if best is not None:
                    gone.add(key)
                    used.add(best)
                    out.append((key, best, level))
        names = [left, right, score]
        return pa.table([pa.array([r[i] for r in out], table.schema.field(n).type) for i, n in enumerate(names)], names=names)

    found = rows.join(roots, "node").drop("node").groupBy("root")
    return found.applyInArrow(greedy, ", ".join(f"`{c}` {kinds[c]}" for c in (left, right, score)))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (u, v) is connected with.

    Alternating stars: links move to ever smaller nodes until nothing changes, in logarithmically many rounds.
    """
    from pyspark.sql import Window

    from bocage.session import checkpoint

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    links = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, now = None, state(links)
    while now != before:
        least = F.min("v").over(Window.partitionBy("u"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("m", F.least("u", least))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.withColumn("m", least)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        links = checkpoint(small.distinct())
        before, now = now, state(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
