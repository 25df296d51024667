"""Joins, set operations and keyed updates over the registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import geo, text
from bocage.operators import enrich, query
from bocage.operators.communes import with_commune
from bocage.session import table


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation, region and order count; customers without orders stay."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = enrich.star(enrich.star(enrich.star(base, "c_nationkey", nation), "n_regionkey", region), "c_custkey", orders)
    return out.select("c_custkey", "n_name", "r_name", "n_orders")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities hosted at an address by branches with different null rules, as ordered arrays."""
    people = table(spark, sf_dir, "annuaire_ameli").select("id", "adresse", "code_insee", "specialite_code", "specialite_libelle").distinct()
    people = people.where(F.trim("adresse") != "")

    def branch(label: str, keep, least: int) -> DataFrame:
        groups = people.where(keep).groupBy("code_insee", "adresse").agg(F.countDistinct("id").alias("n"))
        return groups.where(F.col("n") >= least).select("code_insee", "adresse", F.lit(label).alias("activity"))

    branches = branch("biologie", F.col("specialite_libelle").ilike("Médecin bio%") & ~F.col("specialite_code").isin("01"), 1)
    branches = branches.unionByName(branch("groupe", ~F.col("specialite_code").eqNullSafe("24"), 3))
    branches = branches.unionByName(branch("infirmier", F.col("specialite_code") == "24", 1))
    return branches.groupBy("code_insee", "adresse").agg(F.array_sort(F.collect_set("activity")).alias("activities"), F.count("*").alias("n_activities"))


def visited_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders enriched from their customer's segment, every row marked found or unmatched."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    some = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    out = enrich.with_visited(orders, some, "c_custkey", "c_mktsegment", "join", "unmatched")
    return out.groupBy("provenance", "c_mktsegment").agg(F.count("*").alias("n_rows"))


def cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses placed through accepted entries of a cache on their normalised key."""
    people = table(spark, sf_dir, "annuaire_ameli").where("adresse IS NOT NULL").select("id", "adresse", "code_postal", "code_insee", "geom", "geom_source").distinct()
    key = text.address_key(F.col("adresse"), F.col("code_postal"), F.col("code_insee"))
    cache = people.withColumn("address_key", key).groupBy("address_key").agg(
        F.max(F.col("geom_source") == "ban_address").alias("accepted"), F.max("geom").alias("cached")
    )
    out = enrich.through_cache(people, key, cache, "address_key", F.col("accepted"), ["cached"])
    return out.groupBy("geom_source").agg(F.count("*").alias("n_rows"), F.count("cached").alias("n_placed"))


def commune_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes of rows by code, else by name and postal code."""
    rows = table(spark, sf_dir, "centres_sante").select("etab_finess", "code_insee", "code_postal", "ville").distinct()
    out = with_commune(rows, table(spark, sf_dir, "communes"), F.col("code_insee"), F.col("code_postal"), F.col("ville"))
    return out.select("etab_finess", "code_insee", "code_postal", "ville", "commune")


def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points missing from the latest delivery taken from the earlier one."""
    rows = table(spark, sf_dir, "annuaire_ameli").select("id", F.nullif("geom", F.lit("")).alias("geom"), "geom_source", "created_at")
    new = query.last_per_key(rows, ["id"], ["created_at", "geom"]).withColumn("geom", F.when(F.col("id") % 5 != 0, F.col("geom")))
    old = query.last_per_key(rows.where("created_at < '2026-06-15'"), ["id"], ["created_at", "geom"])
    out = enrich.carried_over(new, old, "id", "geom", "geom_source", "previous")
    return out.groupBy("geom_source").agg(F.count("*").alias("n_rows"), F.count("geom").alias("n_points"))


def centroid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing points taken from the row of the same establishment number in the same commune."""
    rows = table(spark, sf_dir, "centres_sante").select("etab_finess", "code_insee", F.nullif("geom", F.lit("")).alias("geom"), "created_at")
    key, order = ["etab_finess"], ["created_at", "geom", "code_insee"]
    new = query.last_per_key(rows, key, order).withColumns({"geom": F.when(~F.col("etab_finess").rlike("[0-4]$"), F.col("geom")), "geom_source": F.lit("own")})
    # Some numbers stand for an establishment that was in another commune.
    old = query.last_per_key(rows.where("geom IS NOT NULL"), key, order).withColumn("code_insee", F.when(F.col("etab_finess").endswith("3"), "00000").otherwise(F.col("code_insee")))
    out = enrich.carried_over(new, old, ["etab_finess", "code_insee"], "geom", "geom_source", "finess")
    return out.groupBy("geom_source").agg(F.count("*").alias("n_rows"), F.count("geom").alias("n_points"))


def canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that must exist and do not."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return enrich.missing_from(keys, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def generation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation of points against another."""
    rows = table(spark, sf_dir, "annuaire_ameli").select("id", geo.point_lon(F.col("geom")).alias("lon"), geo.point_lat(F.col("geom")).alias("lat"))
    old = rows.where("id % 11 <> 0")
    new = rows.where("id % 7 <> 0").withColumns(
        {"lon": F.when(F.col("id") % 13 != 0, F.col("lon") + F.when(F.col("id") % 5 == 0, 0.02).otherwise(0.0)), "lat": F.when(F.col("id") % 13 != 0, F.col("lat"))}
    )
    return enrich.generation_diff(new, old, "id", 500.0)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every sale row replaces the earlier ones."""
    rows = table(spark, sf_dir, "sirene_etablissements").select("siret", "enseigne", "actif", "date_maj")
    out = enrich.upserted(rows.where("date_maj < '2026-06-15'"), rows.where("date_maj >= '2026-06-15'"), ["siret"], "date_maj")
    return out.select("siret", "actif", "date_maj")


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates known from one source completed and extended by another."""
    part = table(spark, sf_dir, "part")
    known = part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") / 50.0).alias("score"), F.lit(None).cast("string").alias("p_brand"))
    offers = part.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") / 50.0).alias("score"), "p_brand")
    return enrich.merged_candidates(known, offers, "p_partkey", "score", 0.6, ["p_brand"])


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, intersection and distinct union of codes."""
    a = table(spark, sf_dir, "dvf_mutations").select(F.col("code_commune").alias("code")).where("code IS NOT NULL")
    b = table(spark, sf_dir, "sirene_etablissements").select(F.col("code_commune").alias("code")).where("code IS NOT NULL")
    parts = {"only_sales": a.subtract(b), "only_sites": b.subtract(a), "both": a.intersect(b), "either": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        n = df.agg(F.lit(name).alias("part"), F.count("*").alias("n_codes"))
        out = n if out is None else out.unionByName(n)
    return out


QUERIES = {
    "j01_star_join": star_join, "j02_activities": activities, "j04_visited_marker": visited_marker, "j05_cache_join": cache_join,
    "j07_commune_cascade": commune_cascade, "j06_centroid_fallback": centroid_fallback, "j08_carry_over": carry_over, "j09_canary": canary, "j10_generation_counts": generation_counts,
    "k02_upsert": upsert, "j15_candidate_merge": candidate_merge, "u03_set_operations": set_operations,
}

from bocage.plans.cleaning import _LAT, _LON, sql_key_field  # noqa: E402

_KEY = f"{sql_key_field('adresse')} || '|' || {sql_key_field('code_postal')} || '|' || {sql_key_field('code_insee')}"

ORACLE = {
    "j01_star_join": """SELECT c_custkey, n_name, r_name, n_orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "j02_activities": """WITH p AS (SELECT DISTINCT id, adresse, code_insee, specialite_code, specialite_libelle FROM annuaire_ameli WHERE trim(adresse) <> ''),
b AS (SELECT code_insee, adresse, 'biologie' AS activity FROM p WHERE specialite_libelle ILIKE 'Médecin bio%' AND specialite_code <> '01' GROUP BY 1, 2
  UNION ALL SELECT code_insee, adresse, 'groupe' FROM p WHERE specialite_code IS DISTINCT FROM '24' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3
  UNION ALL SELECT code_insee, adresse, 'infirmier' FROM p WHERE specialite_code = '24' GROUP BY 1, 2)
SELECT code_insee, adresse, list(activity ORDER BY activity) AS activities, count(*) AS n_activities FROM b GROUP BY 1, 2""",
    "j04_visited_marker": """SELECT CASE WHEN c.c_custkey IS NULL THEN 'unmatched' ELSE 'join' END AS provenance, c_mktsegment, count(*) AS n_rows
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey GROUP BY ALL""",
    "j05_cache_join": f"""WITH p AS (SELECT DISTINCT id, geom, geom_source, adresse, code_postal, code_insee FROM annuaire_ameli WHERE adresse IS NOT NULL),
k AS (SELECT *, {_KEY} AS address_key FROM p), c AS (SELECT address_key, max(geom) AS cached FROM k GROUP BY 1 HAVING bool_or(geom_source = 'ban_address'))
SELECT geom_source, count(*) AS n_rows, count(cached) AS n_placed FROM k LEFT JOIN c USING (address_key) GROUP BY 1""",
    "j08_carry_over": """WITH r AS (SELECT id, nullif(geom, '') AS geom, geom_source, created_at FROM annuaire_ameli),
n AS (SELECT id, CASE WHEN id % 5 <> 0 THEN geom END AS geom, geom_source FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST) = 1),
o AS (SELECT id, geom AS old FROM r WHERE created_at < '2026-06-15' QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST) = 1)
SELECT CASE WHEN geom IS NULL AND old IS NOT NULL THEN 'previous' ELSE geom_source END AS geom_source, count(*) AS n_rows, count(coalesce(geom, old)) AS n_points
FROM n LEFT JOIN o USING (id) GROUP BY 1""",
    "j06_centroid_fallback": """WITH r AS (SELECT etab_finess, code_insee, nullif(geom, '') AS geom, created_at FROM centres_sante),
n AS (SELECT etab_finess, code_insee, CASE WHEN NOT regexp_matches(etab_finess, '[0-4]$') THEN geom END AS geom FROM r
  QUALIFY row_number() OVER (PARTITION BY etab_finess ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST, code_insee DESC NULLS LAST) = 1),
o AS (SELECT etab_finess, CASE WHEN etab_finess LIKE '%3' THEN '00000' ELSE code_insee END AS code_insee, geom AS old FROM r WHERE geom IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY etab_finess ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST, code_insee DESC NULLS LAST) = 1)
SELECT CASE WHEN geom IS NULL AND old IS NOT NULL THEN 'finess' ELSE 'own' END AS geom_source, count(*) AS n_rows, count(coalesce(geom, old)) AS n_points
FROM n LEFT JOIN o USING (etab_finess, code_insee) GROUP BY 1""",
    "j09_canary": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "j10_generation_counts": f"""WITH r AS (SELECT id, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli),
o AS (SELECT id, max(row(lon, lat)) AS p, max(lon) AS any_lon FROM r WHERE id % 11 <> 0 GROUP BY 1),
o2 AS (SELECT id, max(lon) AS lon, max(lat) AS lat FROM r WHERE id % 11 <> 0 GROUP BY 1),
n2 AS (SELECT id, max(CASE WHEN id % 13 <> 0 THEN lon + CASE WHEN id % 5 = 0 THEN 0.02 ELSE 0.0 END END) AS lon, max(CASE WHEN id % 13 <> 0 THEN lat END) AS lat FROM r WHERE id % 7 <> 0 GROUP BY 1),
b AS (SELECT n2.id AS ni, o2.id AS oi, n2.lon AS nx, n2.lat AS ny, o2.lon AS ox, o2.lat AS oy FROM n2 FULL JOIN o2 ON n2.id = o2.id)
SELECT count_if(oi IS NULL) AS added, count_if(ni IS NULL) AS removed, count_if(oi IS NOT NULL AND ni IS NOT NULL) AS kept,
  count_if(ox IS NOT NULL AND nx IS NULL AND ni IS NOT NULL) AS lost_point,
  count_if(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(oy - ny) / 2), 2) + cos(radians(ny)) * cos(radians(oy)) * pow(sin(radians(ox - nx) / 2), 2)))) > 500) AS moved FROM b""",
    "k02_upsert": """SELECT siret, actif, date_maj FROM sirene_etablissements
QUALIFY row_number() OVER (PARTITION BY siret ORDER BY date_maj >= '2026-06-15' DESC, date_maj DESC) = 1""",
    "j15_candidate_merge": """WITH k AS (SELECT p_partkey, p_size / 50.0 AS score FROM part WHERE p_partkey % 3 = 0), o AS (SELECT p_partkey, p_size / 50.0 AS score, p_brand FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(k.p_partkey, o.p_partkey) AS p_partkey, coalesce(o.score, k.score) AS score, o.p_brand FROM k FULL JOIN o ON k.p_partkey = o.p_partkey
WHERE k.p_partkey IS NOT NULL OR o.score >= 0.6""",
    "u03_set_operations": """WITH a AS (SELECT code_commune AS c FROM dvf_mutations WHERE code_commune IS NOT NULL), b AS (SELECT code_commune AS c FROM sirene_etablissements WHERE code_commune IS NOT NULL)
SELECT 'only_sales' AS part, count(*) AS n_codes FROM (SELECT c FROM a EXCEPT SELECT c FROM b) UNION ALL SELECT 'only_sites', count(*) FROM (SELECT c FROM b EXCEPT SELECT c FROM a)
UNION ALL SELECT 'both', count(*) FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT c FROM a UNION SELECT c FROM b)""",
}
