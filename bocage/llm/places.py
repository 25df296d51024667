"""Problem 7: one postal address written differently.

Each address is taken apart and expanded into all its plausible normalised forms: any number may
be the door, any typed part the street, and each street word may stand for every spelling of it,
within the errors its length allows, that either table knows.  Combinations of whole components
(commune, door and street word; commune and named place) are hashed, exploded and equi-joined;
candidates that share a hash are verified, and conflicting house numbers are rejected.

Spellings are found by deletion neighbourhoods over the list of words, which loses none and is
small beside the addresses.  Equal addresses are one node throughout, so a door shared by a third
of all rows is compared once.

Defined results: rows without key take no part; null, blank or partless addresses and rows
whose commune cannot be resolved match nothing; repeated rows give a pair once; extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.llm.addresses import Address, readings, same_location
from bocage.llm.spelling import similar_words
from bocage.operators.communes import with_commune
from bocage.session import checkpoint

_FORMS_SCHEMA = "node string, door string, word string"


def _pack(forms: tuple[Address, ...]) -> str:
    return "\x1e".join("\x1d".join((str(a.number), a.suffix, a.street_type, " ".join(a.words), a.place)) for a in forms)


@lru_cache(maxsize=20_000)
def _unpack(text: str) -> tuple[Address, ...]:
    out = []
    for form in text.split("\x1e"):
        number, suffix, kind, words, place = form.split("\x1d")
        out.append(Address(int(number), suffix, kind, tuple(words.split()), place))
    return tuple(out)


def component_combos(forms: tuple[Address, ...]) -> list[tuple[str, str]]:
    """(door, word) of one address over all its forms: any word may be the one that the other spelling keeps."""
    out = set()
    for a in forms:
        if a.number >= 0:
            out.update((f"{a.number}{a.suffix}", w) for w in a.words if len(w) > 1)
        if a.place:
            out.add(("p", a.place.split(" ")[-1]))
    return sorted(out)


def _parsed(batches):
    for pdf in batches:
        nodes = [f"{r.commune}\x1c{_pack(readings(r.f1, r.f2, r.f3))}" for r in pdf.itertuples(index=False)]
        yield pd.DataFrame({"key": pdf["key"], "node": nodes})


def _expanded(batches):
    for pdf in batches:
        rows = []
        for node in pdf["node"]:
            commune, _, parts = node.partition("\x1c")
            rows += [(node, f"{commune}|{door}", word) for door, word in component_combos(_unpack(parts))]
        yield pd.DataFrame(rows, columns=["node", "door", "word"])


def _verified(batches):
    for pdf in batches:
        parts = lambda node: _unpack(node.partition("\x1c")[2])
        keep = [any(same_location(x, y) for x in parts(a) for y in parts(b)) for a, b in zip(pdf["a_node"], pdf["b_node"])]
        yield pdf.loc[keep, ["a_node", "b_node"]]


def parsed(df: DataFrame) -> DataFrame:
    """(key, node) of rows as ``address_fields`` returns them: the node is the address with all its readings."""
    kind = df.schema["key"].dataType.simpleString()
    return checkpoint(df.mapInPandas(_parsed, f"key {kind}, node string"))


def same_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_node, b_node) of addresses that denote one location; inputs as ``parsed`` returns."""
    # The combinations of either side are read for the words and for the join.
    a, b = (checkpoint(df.select("node").distinct().mapInPandas(_expanded, _FORMS_SCHEMA)) for df in (left, right))
    spelt = checkpoint(similar_words(a.select("word"), b.select("word")))
    forms = b.join(spelt, b["word"] == spelt["b"]).select("node", "door", F.col("a").alias("word")).unionByName(b)
    keyed = lambda df, side: df.select(F.xxhash64("door", "word").alias("combo"), F.col("node").alias(f"{side}_node"))
    pairs = keyed(a, "a").join(keyed(forms, "b"), "combo").drop("combo").distinct()
    return pairs.mapInPandas(_verified, "a_node string, b_node string")


def same_addresses(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key) of records that denote one location; inputs as ``address_fields`` returns."""
    left, right = parsed(left), parsed(right)
    same = same_nodes(left, right)

    def members(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("node").alias(f"{side}_node"), F.col("key").alias(f"{side}_key")).distinct()

    return (
        same.join(members(left, "a"), "a_node")
        .join(members(right, "b"), "b_node")
        .select(F.col("a_key").alias("left_key"), F.col("b_key").alias("right_key"))
        .distinct()
    )


def linked_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, key, place, n_links): one row per record with the class of its address and the number of records of the other side it denotes one location with.

    Pairs of records are not written out: members of a class share its links.
    """
    left, right = parsed(left), parsed(right)
    same = checkpoint(same_nodes(left, right))
    sizes = lambda df, side: df.distinct().groupBy(F.col("node").alias(f"{side}_node")).agg(F.count("*").alias("n"))

    def counted(df: DataFrame, side: str, other: str, name: str) -> DataFrame:
        links = same.join(sizes(right if side == "a" else left, other), f"{other}_node").groupBy(f"{side}_node").agg(F.sum("n").alias("n_links"))
        keys = df.select(F.col("key").cast("string").alias("key"), "node").distinct()
        out = keys.join(links, F.col("node") == F.col(f"{side}_node"), "left")
        return out.select(F.lit(name).alias("side"), "key", F.xxhash64("node").alias("place"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    return counted(left, "a", "b", "left").unionByName(counted(right, "b", "a", "right"))


def address_fields(
    df: DataFrame, key: str, fields: list[Column], communes: DataFrame, code: Column, postal: Column, town: Column
) -> DataFrame:
    """Rows ready for ``same_addresses``: key, resolved commune and up to three address fields."""
    three = [*fields, *[F.lit(None).cast("string")] * (3 - len(fields))]
    flat = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), code.alias("code"), postal.alias("postal"), town.alias("town"),
        *(c.alias(f"f{i}") for i, c in enumerate(three, 1)),
    )
    placed = with_commune(flat, communes, F.col("code"), F.col("postal"), F.col("town"))
    return placed.where(F.col("commune").isNotNull()).select("key", "commune", "f1", "f2", "f3")
