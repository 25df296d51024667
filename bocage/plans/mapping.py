"""Row mappers, look-ups by key and area, permits windows and temporal states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bocage.functions import geo
from bocage.operators import mappers, proximity, query, rejects
from bocage.session import table


def practitioner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that loaded, as directory rows or with the reason they are skipped."""
    loaded = rejects.strict_load(table(spark, sf_dir, "ameli_raw"))
    text = loaded.select("raw_id", *[F.col(c).cast("string").alias(c) for c in rejects.FIELDS])
    rows = mappers.practitioner_rows(text)
    return rows.groupBy("skip_reason", "code_departement").agg(
        F.count("*").alias("n_rows"), F.count("adresse").alias("n_addresses"), F.count("telephone").alias("n_phones"), F.max("nom").alias("last_name")
    )


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practitioner activities with joined address parts."""
    raw = table(spark, sf_dir, "annuaire_ameli").select(F.col("id").cast("string").alias("k"), "nom", "prenom", "adresse", "ville", "code_postal").distinct()
    return mappers.activity_rows(raw, "k", "nom", "prenom", ["adresse", "ville"], "code_postal")


def centre_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres with checked identifiers and plain defaults."""
    raw = table(spark, sf_dir, "centres_sante").select("etab_finess", "etab_raison_sociale", "type_etab_libelle", "voie", "code_postal").distinct()
    return mappers.centre_rows(raw)


def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points given in degrees or in projected metres, resolved; derived metres from integer keys."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 100) / 10.0).alias("lon0"), F.when(F.col("c_custkey") % 3 == 0, F.lit(45.5)).alias("lat0"),
        (F.col("c_custkey") % 1000 * 700.0 + 300_000.0).alias("x"), (F.col("c_custkey") % 700 * 1000.0 + 6_200_000.0).alias("y"),
    )
    spot = geo.resolved_point(F.col("lon0"), F.col("lat0"), F.col("x"), F.col("y"))
    out = df.select("c_custkey", F.round(spot["lon"], 6).alias("lon"), F.round(spot["lat"], 6).alias("lat"), spot["layout"].alias("layout"))
    return out.withColumn("inside", geo.in_france(F.col("lon"), F.col("lat")))


def by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open establishments of some activities in a département, by commune and key."""
    df = table(spark, sf_dir, "sirene_etablissements").where("actif AND code_commune LIKE '01%'")
    df = query.optional_in(df, "naf", ["86.21Z", "86.23Z"])
    return df.select("siret", "naf", "code_commune").distinct()


def radius_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes within 40 km of the centre of another."""
    towns = table(spark, sf_dir, "communes").select("code_insee", "lon", "lat", "population")
    middle = towns.where("code_insee = '01910'").select("lon", "lat")
    near = proximity.near_spots(middle, towns.select("lon", "lat").distinct(), 40_000.0).select(F.col("bx").alias("lon"), F.col("by").alias("lat"), "metres")
    return towns.join(near, ["lon", "lat"]).select("code_insee", "population", F.round("metres", 3).alias("metres"))


def sales_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last full years by commune, the running year apart."""
    df = table(spark, sf_dir, "dvf_mutations").where("date_mutation IS NOT NULL").select("code_commune", F.year("date_mutation").alias("y"), F.month("date_mutation").alias("m"))
    years = df.groupBy("code_commune", "y").agg(F.count("*").alias("n"), F.countDistinct("m").alias("months"))
    last = F.max(F.when(F.col("months") == 12, F.col("y"))).over(Window.partitionBy("code_commune"))
    return years.withColumn("last_full", last).groupBy("code_commune").agg(
        F.coalesce(F.sum(F.when((F.col("y") <= F.col("last_full")) & (F.col("y") > F.col("last_full") - 2), F.col("n"))), F.lit(0)).alias("n_full"),
        F.coalesce(F.sum(F.when(F.col("y") > F.coalesce("last_full", F.lit(0)), F.col("n"))), F.lit(0)).alias("n_running"),
    )


def period_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each establishment from its periods."""
    df = table(spark, sf_dir, "sirene_etablissements").groupBy("siret").agg(
        F.max_by(F.struct("actif", "date_creation", "date_fermeture"), F.struct("date_maj", "actif")).alias("r")
    )
    kind = "array<struct<from:date,until:date,state:string>>"
    first = F.struct(F.col("r.date_creation").alias("from"), F.when(~F.col("r.actif"), F.col("r.date_fermeture")).alias("until"), F.lit("A").alias("state"))
    second = F.struct(F.col("r.date_fermeture").alias("from"), F.lit(None).cast("date").alias("until"), F.lit("F").alias("state"))
    periods = F.when(F.col("r.actif"), F.array(first)).otherwise(F.array(first, second)).cast(kind)
    return df.withColumn("p", periods).select("siret", *[v.alias(k) for k, v in mappers.current_period(F.col("p")).items()])


def precision_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the points of each département's specialities."""
    label = F.when(F.col("geom_source") == "ban_address", "precise").when(F.col("geom_source") == "commune_centroid", "centroid")
    df = table(spark, sf_dir, "annuaire_ameli").withColumn("label", label)
    return mappers.precision_summary(df, ["code_departement", "specialite_code"], "label")


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result confidence by kind, and a clarified label."""
    kind = F.element_at(F.array(*map(F.lit, ["housenumber", "street", "municipality"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") % 100) / 100.0).alias("score"))
    label = mappers.clarified(df, "kind", "kind", {"municipality": ("municipality", "commune")})
    return df.select("p_partkey", label.alias("kind_label"), mappers.geocode_confidence(F.col("score"), F.col("kind")).alias("confidence"))


QUERIES = {
    "proj08_practitioner_rows": practitioner_rows, "proj07_activity_rows": activity_rows, "proj09_centre_rows": centre_rows,
    "m04_projected_points": projected_points, "c02_by_area": by_area, "j12_radius_of_code": radius_of_code,
    "c20_sales_window": sales_window, "c41_period_states": period_states, "c38_precision_summaries": precision_summaries, "proj22_confidence": confidence,
}

from bocage.plans.problems import _SQL_RAW  # noqa: E402

_DEP = """CASE WHEN {c}[1:2] IN ('97', '98') THEN {c}[1:3] ELSE {c}[1:2] END"""
_DEP_POSTAL = r"""CASE WHEN regexp_matches(trim({p}), '^\d{{5}}') AND trim({p})[1:2] <> '20' AND regexp_full_match(CASE WHEN trim({p})[1:2] IN ('97', '98') THEN trim({p})[1:3] ELSE trim({p})[1:2] END,
  '(0[1-9]|1\d|2[1-9]|[3-8]\d|9[0-5]|97[1-8]|98[4-8])') THEN CASE WHEN trim({p})[1:2] IN ('97', '98') THEN trim({p})[1:3] ELSE trim({p})[1:2] END END"""

_N, _C, _X, _Y = geo._L93_N, geo._L93_C, geo._L93_X, geo._L93_Y
_E2 = geo._L93_E**2
_SERIES = (
    _E2 / 2 + 5 * _E2**2 / 24 + _E2**3 / 12 + 13 * _E2**4 / 360, 7 * _E2**2 / 48 + 29 * _E2**3 / 240 + 811 * _E2**4 / 11520,
    7 * _E2**3 / 120 + 81 * _E2**4 / 1120, 4279 * _E2**4 / 161280,
)

ORACLE = {
    "m04_projected_points": f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 100) / 10.0 END AS lon0, CASE WHEN c_custkey % 3 = 0 THEN 45.5 END AS lat0,
  c_custkey % 1000 * 700.0 + 300000.0 AS x, c_custkey % 700 * 1000.0 + 6200000.0 AS y FROM customer),
c AS (SELECT *, 2 * atan(pow({_C!r} / sqrt(pow(x - {_X}, 2) + pow(y - {_Y!r}, 2)), 1 / {_N!r})) - pi() / 2 AS chi FROM r),
d AS (SELECT *, lon0 IS NOT NULL AND NOT (lon0 = 0 AND lat0 = 0) AS direct, x BETWEEN 0 AND 1.3e6 AND y BETWEEN 6.0e6 AND 7.2e6 AS projected FROM c),
o AS (SELECT c_custkey, round(CASE WHEN direct THEN lon0 WHEN projected THEN 3.0 + degrees(atan2(x - {_X}, {_Y!r} - y)) / {_N!r} END, 6) AS lon,
  round(CASE WHEN direct THEN lat0 WHEN projected THEN degrees(chi + {" + ".join(f"{c!r} * sin({2 * k} * chi)" for k, c in enumerate(_SERIES, 1))}) END, 6) AS lat,
  CASE WHEN direct AND projected THEN 'degrees_first' WHEN direct THEN 'degrees_only' WHEN projected THEN 'projected_only' ELSE 'unusable' END AS layout FROM d)
SELECT *, coalesce(lon BETWEEN -65 AND 60 AND lat BETWEEN -25 AND 52, false) AS inside FROM o""",
    "proj08_practitioner_rows": _SQL_RAW
    + f""", l AS (SELECT list_transform(t, lambda x: nullif(trim(x), '')) AS c FROM judged WHERE reason IS NULL),
r AS (SELECT CASE WHEN c[2] IN ('3', '4') THEN 'type' WHEN coalesce(c[3], c[4]) IS NULL THEN 'no_name' WHEN c[9] IS NULL AND c[11] IS NULL THEN 'no_place' END AS skip_reason,
  coalesce({_DEP.format(c="c[11]")}, {_DEP_POSTAL.format(p="c[9]")}) AS code_departement, coalesce(c[3], c[4]) AS nom, coalesce(c[7], c[8]) AS adresse,
  nullif(trim(regexp_replace(regexp_split_to_array(c[12], '[/;,]')[1], '[\\s.\\-()]', '', 'g')), '') AS telephone FROM l)
SELECT skip_reason, code_departement, count(*) AS n_rows, count(adresse) AS n_addresses, count(telephone) AS n_phones, max(nom) AS last_name FROM r GROUP BY 1, 2""",
    "proj07_activity_rows": """WITH r AS (SELECT DISTINCT id, nom, prenom, adresse, ville, code_postal FROM annuaire_ameli)
SELECT CAST(id AS VARCHAR) AS rpps_id, nullif(trim(nom), '') AS nom, nullif(trim(prenom), '') AS prenom,
  nullif(trim(concat_ws(' ', nullif(trim(adresse), ''), nullif(trim(ville), ''))), '') AS adresse, trim(code_postal)[1:5] AS code_postal
FROM r WHERE id IS NOT NULL AND trim(r.nom) <> '' AND trim(r.prenom) <> ''""",
    "proj09_centre_rows": rf"""WITH r AS (SELECT DISTINCT etab_finess, etab_raison_sociale, type_etab_libelle, voie, code_postal FROM centres_sante)
SELECT trim(etab_finess) AS etab_finess, coalesce(nullif(trim(regexp_replace(regexp_replace(etab_raison_sociale, '[\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g')), ''), '_unknown_') AS etab_raison_sociale,
  coalesce(nullif(trim(regexp_replace(regexp_replace(type_etab_libelle, '[\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g')), ''), '_unknown_') AS type_etab_libelle, nullif(trim(voie), '') AS voie,
  {_DEP_POSTAL.format(p="code_postal")} AS dep, CASE WHEN NOT coalesce(regexp_full_match(trim(etab_finess), '\d{{9}}'), false) THEN 'bad_id' END AS skip_reason FROM r""",
    "c02_by_area": "SELECT DISTINCT siret, naf, code_commune FROM sirene_etablissements WHERE actif AND code_commune LIKE '01%' AND naf IN ('86.21Z', '86.23Z')",
    "j12_radius_of_code": """WITH c AS (SELECT lon AS x0, lat AS y0 FROM communes WHERE code_insee = '01910'),
d AS (SELECT code_insee, population, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(y0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y0)) * pow(sin(radians(x0 - lon) / 2), 2)))) AS m FROM communes, c)
SELECT code_insee, population, round(m, 3) AS metres FROM d WHERE m <= 40000""",
    "c20_sales_window": """WITH y AS (SELECT code_commune, year(date_mutation) AS y, count(*) AS n, count(DISTINCT month(date_mutation)) AS months FROM dvf_mutations WHERE date_mutation IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, max(y) FILTER (WHERE months = 12) OVER (PARTITION BY code_commune) AS last_full FROM y)
SELECT code_commune, CAST(coalesce(sum(n) FILTER (WHERE y <= last_full AND y > last_full - 2), 0) AS BIGINT) AS n_full, CAST(coalesce(sum(n) FILTER (WHERE y > coalesce(last_full, 0)), 0) AS BIGINT) AS n_running FROM l GROUP BY 1""",
    "c41_period_states": """WITH r AS (SELECT * FROM sirene_etablissements QUALIFY row_number() OVER (PARTITION BY siret ORDER BY date_maj DESC NULLS LAST, actif DESC) = 1)
SELECT siret, actif AS active, CASE WHEN actif THEN date_creation ELSE least(date_creation, date_fermeture) END AS created,
  CASE WHEN NOT actif THEN CASE WHEN date_fermeture IS NULL THEN date_creation ELSE date_fermeture END END AS closed FROM r""",
    "c38_precision_summaries": """WITH r AS (SELECT code_departement, specialite_code, count(*) FILTER (WHERE geom_source IN ('ban_address', 'commune_centroid')) AS n, count(*) FILTER (WHERE geom_source = 'ban_address') AS e FROM annuaire_ameli GROUP BY 1, 2)
SELECT code_departement, specialite_code, CASE WHEN n = 0 THEN NULL WHEN e = n THEN 'precise' WHEN e = 0 THEN 'centroid' ELSE 'mixed' END AS precision, n AS n_labelled FROM r""",
    "proj22_confidence": """WITH r AS (SELECT p_partkey, ['housenumber', 'street', 'municipality'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 100) / 100.0 END AS score FROM part)
SELECT p_partkey, CASE kind WHEN 'municipality' THEN 'commune' ELSE kind END AS kind_label,
  CASE WHEN score IS NULL OR score < CASE kind WHEN 'housenumber' THEN 0.7 WHEN 'street' THEN 0.6 ELSE 0.5 END THEN 'low' ELSE 'ok' END AS confidence FROM r""",
}
