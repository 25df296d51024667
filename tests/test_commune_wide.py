"""Matching of two lists meets every pair of a commune, whatever the numbers in their addresses."""

import duckdb
import pytest

from bocage.plans import matching as plans
from bocage.plans.cleaning import sql_compare


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in ("centres_sante", "sirene_etablissements"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{name}.parquet')")
    return connection


def test_reconciliations_meet_all_pairs_of_a_commune(spark, con):
    line = plans._SITE_LINE
    wanted = con.execute(f"""WITH c AS (SELECT DISTINCT etab_finess, {sql_compare("etab_raison_sociale")} AS na, {sql_compare("voie")} AS aa, code_insee AS c FROM centres_sante WHERE code_insee IS NOT NULL),
s AS (SELECT DISTINCT siret, {sql_compare("raison_sociale_unite_legale")} AS nb, {sql_compare(line)} AS ab, code_commune AS c FROM sirene_etablissements WHERE actif),
d AS (SELECT etab_finess, siret, {plans.sql_dice("na", "nb")} AS n, {plans.sql_dice("aa", "ab")} AS a FROM c JOIN s USING (c))
SELECT DISTINCT etab_finess, siret, round(n, 3), round(a, 3), round(n * 0.5 + a * 0.4, 3) FROM d WHERE round(n * 0.5 + a * 0.4, 3) >= 0.5""").fetchall()
    got = [tuple(r)[:5] for r in plans.reconciliations(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(wanted)


def test_coverage_matches_all_addresses_of_a_commune(spark, con):
    pairs = con.execute(f"""WITH l AS (SELECT DISTINCT etab_finess AS k, {sql_compare("voie")} AS a, code_insee AS c FROM centres_sante WHERE code_insee IS NOT NULL),
r AS (SELECT DISTINCT siret AS k, {sql_compare(plans._SITE_LINE)} AS b, code_commune AS c FROM sirene_etablissements WHERE actif),
d AS (SELECT l.k AS lk, r.k AS rk, {plans.sql_dice("a", "b")} AS s FROM l JOIN r USING (c))
SELECT lk, rk, round(max(s), 6) FROM d WHERE s >= 0.7 GROUP BY 1, 2""").fetchall()
    used, expected = set(), []
    for left, right, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if ("l", left) not in used and ("r", right) not in used:
            used |= {("l", left), ("r", right)}
            expected.append((left, right, score))
    got = [(r["lkey"], r["rkey"], r["score"]) for r in plans.coverage(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(expected)
    counts = plans.coverage_ratio(spark, "/root/testdata/sf0.01").collect()
    only = plans.coverage_only(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_matched"] for r in counts) == len(expected)
    assert sum(r["n_centres_only"] + r["n_sites_only"] for r in counts) == len(only)
    assert all(r["ratio"] is None for r in counts if not r["n_sites"]) and any(r["ratio"] for r in counts)
