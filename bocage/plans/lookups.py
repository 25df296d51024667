"""Filters, radius scans, nearest neighbours, paging and top-k over the registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import codes
from bocage.operators import query
from bocage.session import table

LON, LAT = 7.2, 44.15


_PEOPLE = ["id", "nom", "prenom", "specialite_code", "code_departement", "code_insee", "geom", "geom_source", "created_at"]


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory rows once each: of a row delivered twice the later."""
    return query.last_per_key(table(spark, sf_dir, "annuaire_ameli").select(_PEOPLE), ["id"], ["created_at", "geom"])


def _people_near(spark: SparkSession, sf_dir: str, radius_m: float) -> DataFrame:
    return query.last_near(table(spark, sf_dir, "annuaire_ameli").select(_PEOPLE), ["id"], ["created_at", "geom"], LON, LAT, radius_m)


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["etab_finess", "specialites_codes", "accepte_carte_vitale", "accepte_apcv", "code_departement", "geom", "created_at"]
    return query.last_per_key(table(spark, sf_dir, "centres_sante").select(columns), ["etab_finess"], ["created_at", "geom"])


def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conditions that apply only where given."""
    df = table(spark, sf_dir, "annuaire_ameli").select("id", "code_departement", "specialite_code", "secteur_conventionnel_code")
    df = query.optional_equal(df, "code_departement", "01")
    df = query.optional_equal(df, "secteur_conventionnel_code", None)
    return query.optional_in(query.optional_in(df, "specialite_code", ["01", "24"]), "id", []).distinct()


def lenient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of the wanted categories or of none, under two different defaults."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("category"))
    one = query.lenient_category(df, "category", [], ["MACHINERY"]).withColumn("rule", F.lit("default"))
    return one.unionByName(query.lenient_category(df, "category", ["AUTOMOBILE", "FURNITURE"]).withColumn("rule", F.lit("given")))


def array_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres by overlap, membership and number of specialities."""
    df = query.overlapping(_centres(spark, sf_dir), "specialites_codes", ["01", "19"])
    return df.select("etab_finess", F.array_contains("specialites_codes", "19").alias("dentist"), F.size("specialites_codes").alias("n_codes"))


def pattern_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix patterns, and the two ways to exclude a value that treat null differently."""
    df = table(spark, sf_dir, "sirene_etablissements").select("siret", "naf", "denomination_usuelle").distinct()
    return df.agg(
        F.count_if(F.col("denomination_usuelle").ilike("CAB%")).alias("n_prefix"),
        F.count_if(~F.col("naf").isin("86.21Z")).alias("n_not_in"), F.count_if(~F.col("naf").eqNullSafe("86.21Z")).alias("n_distinct_from"),
    )


def code_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales of a commune given by its own or its districts' codes."""
    low, high = codes.district_range("01910")
    df = table(spark, sf_dir, "dvf_mutations").where(F.col("code_commune").between(low, high))
    return df.groupBy("code_commune", "type_local").agg(F.count("*").alias("n_rows"))


def known_code_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested codes the dictionary lacks."""
    wanted = spark.createDataFrame([("01",), ("24",), ("ZZ",), ("99",)], "code string")
    known = table(spark, sf_dir, "annuaire_ameli").select(F.col("specialite_code").alias("code")).where("code IS NOT NULL")
    return query.unknown_codes(wanted, known)


def people_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precise points within 5 km and their distances."""
    near = _people_near(spark, sf_dir, 5000.0).where(F.col("geom_source") == "ban_address")
    return near.select("id", F.round("distance_m", 3).alias("distance_m"))


def nearest_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 closest of a speciality."""
    some = _people_near(spark, sf_dir, 20_000.0).where("specialite_code = '24' AND geom_source = 'ban_address'")
    near = query.nearest(some, 25, "id")
    return near.select("id", F.round("distance_m", 3).alias("distance_m"))


def centres_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres within 30 km with their services."""
    near = query.in_radius(query.with_point(_centres(spark, sf_dir)), LON, LAT, 30_000.0)
    return near.select("etab_finess", "accepte_carte_vitale", "accepte_apcv", F.round("distance_m", 3).alias("distance_m"))


def hybrid_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precise rows by distance, the rest by their commune's centroid, best 200."""
    rows = query.with_point(_people(spark, sf_dir)).withColumn("precise", F.col("geom_source") == "ban_address")
    towns = table(spark, sf_dir, "communes").select(F.col("code_insee"), "lon", "lat")
    out = query.hybrid_radius(rows.select("id", "code_insee", "lon", "lat", "precise"), towns, "code_insee", LON, LAT, 8000.0, 200, "id")
    return out.select("id", "precision", F.round("distance_m", 3).alias("distance_m"))


def paged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a département in name order, nulls last."""
    rows = _people(spark, sf_dir).where("code_departement = '01'").select("id", "nom", "prenom")
    return query.page(rows, [F.col("nom").asc_nulls_last(), F.col("prenom").asc_nulls_last(), F.col("id")], 40, 20)


def truncated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest orders, and whether there are more."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return query.truncated(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 30)


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: rows after a cursor in key order."""
    return query.after_key(_people(spark, sf_dir).select("id", "nom"), "id", 100, 50)


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each postal code with its first row by id."""
    rows = table(spark, sf_dir, "annuaire_ameli").where("code_postal IS NOT NULL").select("code_postal", "id").distinct()
    return query.first_per_key(rows, ["code_postal"], "id")


def top_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three richest customers of each nation."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return query.top_per_group(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


QUERIES = {
    "f01_optional_filters": optional_filters, "f03_lenient_filter": lenient_filter, "f05_array_filters": array_filters,
    "f12_code_range": code_range, "f13_pattern_filters": pattern_filters, "f23_known_code_guard": known_code_guard,
    "c11_people_in_radius": people_in_radius, "t01_nearest_people": nearest_people, "c12_centres_in_radius": centres_in_radius,
    "c06_hybrid_people": hybrid_people, "t02_paged_people": paged_people, "t03_truncated_sales": truncated_sales,
    "t05_keyset_page": keyset_page, "t06_distinct_keys": distinct_keys, "j11_top_per_nation": top_per_nation,
}


def sql_point(which: int) -> str:
    return f"try_cast(regexp_extract(geom, '(?i)POINT *[(] *([-+0-9.]+) +([-+0-9.]+) *[)]', {which}) AS DOUBLE)"


def sql_metres(lon: str, lat: str) -> str:
    return (
        f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({LAT} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({LAT}))"
        f" * pow(sin(radians({LON} - {lon}) / 2), 2))))"
    )


SQL_PEOPLE = f"""people AS (SELECT * EXCLUDE (geom), {sql_point(1)} AS lon, {sql_point(2)} AS lat FROM annuaire_ameli
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST) = 1)"""
SQL_PLACED = f"""{SQL_PEOPLE}, placed AS (SELECT *, {sql_metres("lon", "lat")} AS m FROM people WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0))"""
SQL_CENTRES = f"""centres AS (SELECT * EXCLUDE (geom), {sql_point(1)} AS lon, {sql_point(2)} AS lat FROM centres_sante
  QUALIFY row_number() OVER (PARTITION BY etab_finess ORDER BY created_at DESC NULLS LAST, geom DESC NULLS LAST) = 1)"""

ORACLE = {
    "f01_optional_filters": """SELECT DISTINCT id, code_departement, specialite_code, secteur_conventionnel_code FROM annuaire_ameli
WHERE code_departement = '01' AND specialite_code IN ('01', '24')""",
    "f03_lenient_filter": """WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS category FROM customer)
SELECT c_custkey, category, 'default' AS rule FROM c WHERE category = 'MACHINERY' OR category IS NULL
UNION ALL SELECT c_custkey, category, 'given' FROM c WHERE category IN ('AUTOMOBILE', 'FURNITURE') OR category IS NULL""",
    "f05_array_filters": f"""WITH {SQL_CENTRES} SELECT etab_finess, list_contains(specialites_codes, '19') AS dentist, len(specialites_codes) AS n_codes
FROM centres WHERE list_has_any(specialites_codes, ['01', '19'])""",
    "f12_code_range": "SELECT code_commune, type_local, count(*) AS n_rows FROM dvf_mutations WHERE code_commune BETWEEN '01910' AND '01910' GROUP BY ALL",
    "f13_pattern_filters": """SELECT count_if(denomination_usuelle ILIKE 'CAB%') AS n_prefix, count_if(naf <> '86.21Z') AS n_not_in,
  count_if(naf IS DISTINCT FROM '86.21Z') AS n_distinct_from FROM (SELECT DISTINCT siret, naf, denomination_usuelle FROM sirene_etablissements)""",
    "f23_known_code_guard": """SELECT code FROM (VALUES ('01'), ('24'), ('ZZ'), ('99')) v(code)
WHERE code NOT IN (SELECT specialite_code FROM annuaire_ameli WHERE specialite_code IS NOT NULL)""",
    "c11_people_in_radius": f"WITH {SQL_PLACED} SELECT id, round(m, 3) AS distance_m FROM placed WHERE geom_source = 'ban_address' AND m <= 5000",
    "t01_nearest_people": f"""WITH {SQL_PLACED} SELECT id, round(m, 3) AS distance_m FROM placed WHERE geom_source = 'ban_address' AND specialite_code = '24' AND m <= 20000
ORDER BY m, id LIMIT 25""",
    "c12_centres_in_radius": f"""WITH {SQL_CENTRES}, placed AS (SELECT *, {sql_metres("lon", "lat")} AS m FROM centres WHERE lon IS NOT NULL AND NOT (lon = 0 AND lat = 0))
SELECT etab_finess, accepte_carte_vitale, accepte_apcv, round(m, 3) AS distance_m FROM placed WHERE m <= 30000""",
    "c06_hybrid_people": f"""WITH {SQL_PLACED}, near AS (SELECT id, m, 'precise' AS precision FROM placed WHERE geom_source = 'ban_address' AND m <= 8000 ORDER BY m, id LIMIT 200),
spots AS (SELECT code_insee, {sql_metres("lon", "lat")} AS m FROM communes),
vague AS (SELECT id, s.m, 'centroid' AS precision FROM placed p JOIN spots s USING (code_insee) WHERE geom_source <> 'ban_address' AND s.m <= 8000
  QUALIFY row_number() OVER (PARTITION BY code_insee ORDER BY id) <= 200)
SELECT id, precision, round(m, 3) AS distance_m FROM (SELECT * FROM near UNION ALL SELECT * FROM (SELECT * FROM vague ORDER BY m, id LIMIT 200)) ORDER BY m, id LIMIT 200""",
    "t02_paged_people": f"""WITH {SQL_PEOPLE} SELECT id, nom, prenom FROM people WHERE code_departement = '01'
ORDER BY nom COLLATE "binary" NULLS LAST, prenom COLLATE "binary" NULLS LAST, id LIMIT 40 OFFSET 20""",
    "t03_truncated_sales": """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 30 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""",
    "t05_keyset_page": f"WITH {SQL_PEOPLE} SELECT id, nom FROM people WHERE id > 100 ORDER BY id LIMIT 50",
    "t06_distinct_keys": "SELECT code_postal, min(id) AS id FROM annuaire_ameli WHERE code_postal IS NOT NULL GROUP BY 1",
    "j11_top_per_nation": """SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
FROM customer QUALIFY rank <= 3""",
}
