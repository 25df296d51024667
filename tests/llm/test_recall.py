"""Planted cases: share of them found, and share of what is found that was planted."""

import random

from pyspark.sql import functions as F

from bocage.llm import linkage, places, variants
from tests.llm.test_registry import CENTRES, PEOPLE, SITES, centre, communes, site

STREETS = ["rue", "avenue", "boulevard", "place", "chemin"]
SHORT = {"rue": "R.", "avenue": "AV", "boulevard": "bd", "place": "pl.", "chemin": "CHE"}


def word(rng, n):
    return "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(n))


def typo(rng, w):
    """One swapped, dropped or doubled letter, never in the first two."""
    i = rng.randint(2, len(w) - 2)
    return rng.choice((w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:]))


def measured(got, truth):
    return len(got & truth) / len(truth), len(got & truth) / max(1, len(got))


def test_addresses_written_differently_are_found(spark):
    rng = random.Random(11)
    left, right, truth = [], [], set()
    for i in range(150):
        kind, name, number = rng.choice(STREETS), word(rng, 4), rng.randint(1, 150)
        bis = rng.choice(("", "", " bis"))
        left.append((i, f"{number}{bis} {kind} {name}", "01910"))
        wrong = typo(rng, name) if i % 2 else name
        forms = (f"{SHORT[kind]} {wrong.upper()} {number}{bis}", f"n° {number}{bis}, {SHORT[kind]} {wrong}, Bâtiment B", f"{wrong} ({kind}), {number:04}{bis}")
        right.append((i, forms[i % 3], "01910"))
        right.append((1000 + i, f"{number + 2}{bis} {kind} {name}", "01910"))
        truth.add((i, i))
    schema, null = "k long, adresse string, code string", F.lit(None).cast("string")
    sides = [places.address_fields(spark.createDataFrame(rows, schema), "k", [F.col("adresse")], communes(spark), F.col("code"), null, null) for rows in (left, right)]
    recall, precision = measured({(r["left_key"], r["right_key"]) for r in places.same_addresses(*sides).collect()}, truth)
    assert recall >= 0.98 and precision >= 0.98, (recall, precision)


def test_variant_names_are_found(spark):
    rng = random.Random(12)
    sites, people, truth = [], [], set()
    for i in range(120):
        a, b = word(rng, 4), word(rng, 4)
        sites.append(site(f"{i:03}a", f"SELARL CABINET DENTAIRE {a.upper()} ET {b.upper()}", str(i + 1), "DU STADE"))
        typed = (f"cab. dent. {b} & {a}", f"CABINET DENTAIRE {typo(rng, a)} {b}", f"Cabinet dentaire {a}-{typo(rng, b)} (SELARL)")[i % 3]
        people.append((i, typed, "MONT DORVIEU", f"{i + 1} rue du Stade", None, "01100", "clash"))
        people.append((1000 + i, f"cabinet dentaire {word(rng, 5)}", "MONT DORVIEU", None, None, "01100", "clash"))
        truth.add((i, f"{i:03}"))
    register = variants.register_names(spark.createDataFrame(sites, SITES), communes(spark))
    typed = variants.typed_names(spark.createDataFrame(people, PEOPLE), communes(spark))
    recall, precision = measured({(r["id"], r["siren"]) for r in variants.link_names(register, typed).collect()}, truth)
    assert recall >= 0.98 and precision >= 0.98, (recall, precision)


def test_sites_without_a_key_are_found(spark):
    rng = random.Random(13)
    centres, sites, truth = [], [], set()
    for i in range(120):
        a, b, street = word(rng, 4), word(rng, 4), word(rng, 4)
        centres.append(centre(f"c{i}", f"CDS dentaire {typo(rng, a) if i % 2 else a} {b}", f"{i + 1} r. {typo(rng, street) if i % 3 == 0 else street}"))
        sites.append(site(f"{i:03}a", f"SAS CENTRE DE SANTE DENTAIRE {a.upper()} {b.upper()}", str(i + 1), street.upper()))
        sites.append(site(f"{i:03}b", f"SAS CENTRE DE SANTE DENTAIRE {a.upper()} {b.upper()}", str(i + 31), word(rng, 4).upper()))
        sites.append(site(f"{i:03}c", f"SCP PHARMACIE {word(rng, 4).upper()}", str(i + 1), street.upper()))
        truth.add((f"c{i}", f"{i:03}a"))
    streets, where = [F.col("voie")], (F.col("code_insee"), F.col("code_postal"), F.col("ville"))
    a = linkage.prepare(spark.createDataFrame(centres, CENTRES), communes(spark), "centre", "etab_finess", [F.col("etab_raison_sociale")], streets, *where)
    b = linkage.prepare(
        spark.createDataFrame(sites, SITES), communes(spark), "site", "siret", [F.col("raison_sociale_unite_legale")],
        [F.col("numero_voie"), F.col("type_voie"), F.col("libelle_voie")], F.col("code_commune"), F.col("code_postal"), F.col("libelle_commune"),
    )
    recall, precision = measured({(r["l"], r["r"]) for r in linkage.link(a, b).collect()}, truth)
    assert recall >= 0.98 and precision >= 0.98, (recall, precision)


def test_large_blocks_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LARGE_BLOCK", 5)
    test_sites_without_a_key_are_found(spark)
