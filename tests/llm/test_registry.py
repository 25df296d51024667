"""Names, addresses and linkage: parsing cases, and operators against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from bocage.llm import linkage, places, variants
from bocage.llm.addresses import parse_address, readings, same_location
from bocage.llm.names import parse_name, trades_agree
from bocage.llm.spelling import edits

COMMUNES = [("01910", "Mont-Dorvieu", ["01100", "01200"], "01", 10, 1.0, 44.0), ("02910", "L'Orme-Bas", ["02100"], "02", 10, 1.0, 45.0)]
COMMUNE_SCHEMA = (
    "code_insee string, nom string, codes_postaux array<string>, code_departement string, population long, lon double, lat double"
)


def communes(spark):
    return spark.createDataFrame(COMMUNES, COMMUNE_SCHEMA)


def test_edits():
    assert edits("thonivard", "tohnivard") == 1 and edits("abc", "abc") == 0 and edits("a", "abcdefgh", 2) == 3


def test_addresses_written_differently():
    same = [
        (("12 rue du Docteur Jean Martel",), ("0012, R. DR MARTEL",)),
        (("17 BIS RT. DU PROF. VALETHELARD", "1er etage gauche"), ("route du Professeur Valethelard 17bis",)),
        (("5 RUE DES 3 ORMEAUX",), ("n°5 r des Trois Ormeaux, Appt 14, CS 20012",)),
        (("22 DU 11 NOVEMBRE",), ("22 rue du Onze Novembre",)),
        (("rue des Tilleuls", "104"), ("104 r. Tilleus",)),
        (("Résidence Bellevue",), ("Residence Belevue", "8 rue du Lavoir")),
        (("DU LAVOIR (BD), N°96",), ("96 boulevard du Lavoir, 01100 MONT-DORVIEU",)),
    ]
    other = [
        (("12 rue du Moulin",), ("12 rue du Vieux Moulin",)),
        (("12 rue du Moulin",), ("12 bis rue du Moulin",)),
        (("12 rue du Moulin",), ("14 rue du Moulin",)),
        (("12 rue du Moulin",), ("12 avenue du Moulin",)),
        (("rue du Moulin",), ("rue du Moulin",)),
        (("12 rue du Pré Martel",), ("12 rue du Bois Martel",)),
        (("12 rue A. Martel",), ("12 rue Zoé Martel",)),
        (("",), ("",)),
        ((None,), ("12 rue du Moulin",)),
    ]
    for a, b in same:
        assert same_location(parse_address(*a), parse_address(*b)), (a, b)
    for a, b in other:
        assert not same_location(parse_address(*a), parse_address(*b)), (a, b)
    assert parse_address("x" * 200_000 + " 12 rue du Lavoir") is not None


def test_names():
    n = parse_name("S.E.L.A.R.L. cab. dentaire B. Lurgage, Rivrot - Mont Dorvieu", "MONT-DORVIEU CEDEX")
    assert (n.words, n.initials, n.legal, set(n.trades), n.form) == (("lurgage", "rivrot"), ("b",), "selarl", {"dent"}, "k")
    assert parse_name(None).words == () and parse_name("  ").words == () and parse_name("_unknown_").words == ()
    assert trades_agree(parse_name("ctre de santé X"), parse_name("cabinet infirmier X")) == -1
    assert trades_agree(parse_name("Saint-X"), parse_name("pharmacie Saint-X")) == 0


def centre(key, name, street, town="Mont-Dorvieu", code="01910", at="2026-01-01"):
    return (key, name, street, None, None, "01100", town, code, at)


CENTRES = "etab_finess string, etab_raison_sociale string, voie string, complement_voie string, lieu_dit string, code_postal string, ville string, code_insee string, created_at string"
SITES = "siret string, siren string, raison_sociale_unite_legale string, enseigne string, denomination_usuelle string, actif boolean, numero_voie string, type_voie string, libelle_voie string, code_postal string, libelle_commune string, code_commune string, date_maj string, key string"


def site(siret, name, number, street, enseigne=None, actif=True, town="Mont-Dorvieu", code="01910", at="2026-01-01"):
    return (siret, siret[:3], name, enseigne, None, actif, number, "RUE", street, "01100", town, code, at, "clash")


NAMES = ["LURGAGE", "RIVROT", "PLUILLANE", "DORVIGNY", "CASTENAC", "BELMOUX", "TRIVELLE", "GANDREAU", "MORVINET", "SALVOISE"]


def link_fixture(spark):
    centres = [centre(f"c{i}", f"CDS dentaire {n.title()} et Test{n.lower()}", f"{i + 1} r. des Acacias") for i, n in enumerate(NAMES)]
    centres += [centre(None, "x", "y"), centre("blank", None, None), centre("lost", "CDS dentaire Nulle", "3 rue du Lavoir", "Ailleurs", None)]
    sites = [site(f"{i:03}a", f"SAS CENTRE DE SANTE DENTAIRE {n} ET TEST{n}", str(i + 1), "DES ACACIAS") for i, n in enumerate(NAMES)]
    sites += [site(f"{i:03}b", f"SAS CENTRE DE SANTE DENTAIRE {n} ET TEST{n}", str(i + 41), "DU STADE") for i, n in enumerate(NAMES)]
    sites += [site(f"{i:03}c", f"SCP PHARMACIE {n}LIER", str(i + 1), "DES ACACIAS") for i, n in enumerate(NAMES)]
    sites += [site("900z", "SAS CENTRE DE SANTE DENTAIRE LURGAGE", "1", "DES ACACIAS", actif=False)]
    return spark.createDataFrame(centres + centres[:3], CENTRES), spark.createDataFrame(sites + sites[:3], SITES)


def records(spark, centres, sites):
    a = linkage.prepare(
        linkage.latest(centres, "etab_finess", "created_at"), communes(spark), "centre", "etab_finess", [F.col("etab_raison_sociale")],
        [F.col("voie"), F.col("complement_voie"), F.col("lieu_dit")], F.col("code_insee"), F.col("code_postal"), F.col("ville"),
    )
    b = linkage.prepare(
        linkage.latest(sites, "siret", "date_maj").where("actif"), communes(spark), "site", "siret", [F.col("raison_sociale_unite_legale"), F.col("enseigne")],
        [F.col("numero_voie"), F.col("type_voie"), F.col("libelle_voie")], F.col("code_commune"), F.col("code_postal"), F.col("libelle_commune"),
    )
    return a, b


def test_linkage(spark):
    a, b = records(spark, *link_fixture(spark))
    links = linkage.link(a, b).collect()
    assert sorted((r["l"], r["r"]) for r in links) == [(f"c{i}", f"{i:03}a") for i in range(len(NAMES))]
    assert all(0.5 <= r["confidence"] <= 1 for r in links)
    assert linkage.link(a.limit(0), b).count() == 0 and linkage.link(a, b.limit(0)).count() == 0


def test_estimate_separates_the_classes():
    levels = list(itertools.product(*map(range, linkage.LEVELS.values())))
    patterns = np.array(levels)
    counts = np.array([1.0 + 500 * (p == (4, 2, 2, 3)) + 900 * (p == (0, 0, 2, 3)) for p in levels])
    post = linkage.estimate(patterns, counts)
    assert post[levels.index((4, 2, 2, 3))] > 0.9 and post[levels.index((0, 0, 2, 3))] < 0.1
    assert len(linkage.estimate(np.zeros((0, 4), dtype=int), np.zeros(0))) == 0


def test_radius_pairs_lose_nothing(spark):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    known, typed = sorted(set(words[:200])), sorted(set(words[100:]))
    df = lambda ws: spark.createDataFrame([("c", w) for w in ws] + [("other", ws[0])], "commune string, variant string")
    got = {(r["variant"], r["known"]) for r in variants.radius_pairs(df(known), df(typed)).where("commune = 'c'").collect()}

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(t, k) for t in typed for k in known if plain(t, k) <= 2}


PEOPLE = "id long, raison_sociale string, ville string, adresse string, code_insee string, code_postal string, siren string"


def test_name_variants(spark):
    _, sites = link_fixture(spark)
    more = [
        site("777a", "SELARL CABINET DE KINESITHERAPIE DU DOCTEUR FREDERIC MERMURE", "3", "DU STADE", enseigne="Flarthola Santé"),
        site("888a", "SARL PHARMACIE MERMURE", "5", "DU STADE"),
        site("999a", "SARL PHARMACIE SALVOISE", "5", "DU STADE", town="L'Orme-Bas", code="02910"),
    ]
    sites = sites.where("siret not like '%b'").union(spark.createDataFrame(more, SITES))
    rows = [
        (1, "Dr Fred Mermure kiné", "777"), (2, "MERMURE PHCIE (S.A.R.L.)", "888"), (3, "kine flartola sante", "777"),
        (4, "c.d.s. dentaire testrivrot & rivrot Mont Dorvieu", "001"), (5, "Docteur Paul Mermure kiné", None), (6, None, None),
        (7, "  ", None), (8, "cabinet d'ophtalmologie Inconnu", None), (9, "PHARMACIE SALVOISE", None), (9, "PHARMACIE SALVOISE", None),
        (10, "Mermure", "888"),
    ]
    people = spark.createDataFrame([(i, n, "MONT DORVIEU", "12 rue X", None, "01100", "clash") for i, n, _ in rows], PEOPLE)
    links = variants.link_names(variants.register_names(sites, communes(spark)), variants.typed_names(people, communes(spark)))
    assert {r["id"]: r["siren"] for r in links.collect()} == {i: s for i, _, s in rows if s}
    none = variants.link_names(variants.register_names(sites.limit(0), communes(spark)), variants.typed_names(people, communes(spark)))
    assert none.count() == 0


def test_same_addresses(spark):
    a = spark.createDataFrame(
        [(1, "3 R. DES ACACIAS", "01910", None, None), (1, "3 R. DES ACACIAS", "01910", None, None), (2, "12 place du Stade", None, "01100", "mont dorvieu cedex"),
         (3, "3 rue des Acacias", "02910", None, None), (4, None, "01910", None, None), (None, "3 rue des Acacias", "01910", None, None), (5, "3 rue des Acacias", None, None, None)],
        "id long, adresse string, code string, cp string, ville string",
    )
    b = spark.createDataFrame(
        [("x", "RUE DES ACACAIS", "N°3", "01910"), ("y", "Hall 2, 12 PL STADE", None, "01910"), ("z", "", "  ", "01910")],
        "f string, voie string, comp string, code string",
    )
    null = F.lit(None).cast("string")
    left = places.address_fields(a, "id", [F.col("adresse")], communes(spark), F.col("code"), F.col("cp"), F.col("ville"))
    right = places.address_fields(b, "f", [F.col("voie"), F.col("comp")], communes(spark), F.col("code"), null, null)
    got = sorted((r["left_key"], r["right_key"]) for r in places.same_addresses(left, right).collect())
    assert got == [(1, "x"), (2, "y")]
    assert places.same_addresses(left.limit(0), right).count() == 0


def test_two_errors_in_a_street_word_still_meet(spark):
    schema = "k long, adresse string, code string"
    left = spark.createDataFrame([(1, "12 rue Montmirail", "01910"), (2, "14 rue Montmirail", "01910"), (3, "7 rue Dupin, 9 avenue Foch", "01910")], schema)
    right = spark.createDataFrame([(10, "12 rue Mnotmirial", "01910"), (11, "9 av. Foch", "01910"), (12, "12 rue Montorail", "02910")], schema)
    null = F.lit(None).cast("string")
    sides = [places.address_fields(df, "k", [F.col("adresse")], communes(spark), F.col("code"), null, null) for df in (left, right)]
    got = {(r["left_key"], r["right_key"]) for r in places.same_addresses(*sides).collect()}
    assert got == {(1, 10), (3, 11)}
    rows = {(r["side"], r["key"]): r["n_links"] for r in places.linked_members(*sides).collect()}
    assert rows == {("left", "1"): 1, ("left", "2"): 0, ("left", "3"): 1, ("right", "10"): 1, ("right", "11"): 1, ("right", "12"): 0}


def test_readings_vary_one_part_at_a_time():
    forms = readings("12 rue des Lilas, 14 avenue Foch")
    assert forms[0] == parse_address("12 rue des Lilas, 14 avenue Foch") and len(forms) == 4
    assert forms[3].number == 14 and forms[3].words == ("foch",)
    assert {f.number for f in forms} == {12, 14} and {f.street_type for f in forms} == {"rue", "avenue"}
    assert len(readings(" , ".join(f"{i} rue Abc{i}" for i in range(2000)))) < 6002
    assert readings(None) == readings("  ") == (parse_address(),)


def test_similar_words_lose_nothing(spark):
    import random

    from bocage.llm.spelling import same_word, similar_words

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 10))) for _ in range(300)}
    for _ in range(30):
        long = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(37, 60)))
        i = rng.randint(0, 30)
        words |= {long, long[:i] + long[i + 1 :], long[:i] + "xy" + long[i:], long[:i] + long[i + 1] + long[i] + long[i + 2 : -1], long[:i] + long[i + 3 :]}
    words |= {"", "x" * 100_000, "x" * 100_001}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = {(r["a"], r["b"]) for r in similar_words(df, df).collect()}
    short = [w for w in words if len(w) < 1000]
    assert {p for p in got if len(p[0]) < 1000} == {(a, b) for a in short for b in short if a != b and same_word(a, b)}
    assert ("x" * 100_000, "x" * 100_001) in got


def test_pairs_of_a_large_block_that_share_one_word_only_meet(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LARGE_BLOCK", 5)
    centres = [centre(f"c{i}", "CDS dentaire Lurgage", None) for i in range(6)]
    sites = [site(f"{i:03}a", "SAS CENTRE DE SANTE DENTAIRE LURGAGE", str(i + 1), n) for i, n in enumerate(NAMES[1:])]
    a, b = records(spark, spark.createDataFrame(centres, CENTRES), spark.createDataFrame(sites, SITES))
    assert {(r["l"], r["r"]) for r in linkage.candidate_pairs(a, b).collect()} == {(f"c{i}", s[0]) for i in range(6) for s in sites}
