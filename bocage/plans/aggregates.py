"""Aggregations over the registry and sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.operators import measures, query
from bocage.plans.lookups import LAT, LON
from bocage.session import table


def count_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: practitioners by five dimensions, null groups kept."""
    return measures.count_cube(
        table(spark, sf_dir, "annuaire_ameli"), ["specialite_code", "type_ps_code", "secteur_conventionnel_code", "code_departement", "geom_source"]
    )


def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: totals from the cube under optional conditions."""
    scopes = {
        "infirmiers 01": {"specialite_code": "24", "code_departement": "01"}, "generalistes": {"specialite_code": "01"}, "inconnu": {"specialite_code": "none"},
    }
    return measures.cube_totals(count_cube(spark, sf_dir), scopes)


def nomenclature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with label, count and shared-label disambiguation."""
    df = table(spark, sf_dir, "annuaire_ameli").where("specialite_code IS NOT NULL AND specialite_libelle IS NOT NULL")
    listed = df.groupBy("specialite_code").agg(F.max("specialite_libelle").alias("libelle"), F.count("*").alias("n"))
    shared = listed.groupBy("libelle").agg(F.count("*").alias("n_codes"))
    named = listed.join(shared, "libelle")
    label = F.when(F.col("n_codes") > 1, F.concat("libelle", F.lit(" (code "), "specialite_code", F.lit(", "), F.col("n"), F.lit(")"))).otherwise(F.col("libelle"))
    return named.select("specialite_code", label.alias("label"), "n")


def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of the precise points of each commune, in whole micro-degrees."""
    rows = query.with_point(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address' AND code_insee IS NOT NULL"))
    mean = lambda c: (F.floor(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count("*") + 0.5) / 1e6).alias(c)
    return rows.groupBy("code_insee").agg(F.count("*").alias("n_points"), mean("lon"), mean("lat"))


def price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact price percentiles and land median in a radius, with counts and date range."""
    df = query.in_radius(
        table(spark, sf_dir, "dvf_mutations").withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")}), LON, LAT, 25_000.0
    )
    price = F.when((F.col("prix_m2") > 0) & (F.col("prix_m2") < 1e12), F.col("prix_m2"))
    land = F.col("surface_terrain") > 0
    plain = df.agg(
        F.count("*").alias("n_rows"), F.count(price).alias("n_prices"), F.count_if(land).alias("n_lands"),
        F.min("date_mutation").alias("first_day"), F.max("date_mutation").alias("last_day"), F.lit(0).alias("_one"),
    )
    wanted = {f"p{round(q * 100)}": (price, q) for q in (0.25, 0.5, 0.75)} | {"median_land": (F.when(land, F.col("surface_terrain")), 0.5)}
    exact = measures.exact_percentiles(df, [], wanted).select(*[F.round(n, 4).alias(n) for n in wanted], F.lit(0).alias("_one"))
    return plain.join(exact, "_one", "left").drop("_one")


def sales_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on the largest table: price percentiles by supplier with a filtered median."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    exact = lambda q, condition=None: F.round(measures.percentile_if(price, q, condition), 9)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), *[exact(q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)], exact(0.5, F.col("l_discount") > 0.05).alias("median_discounted")
    )


def first_wins_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the first line's flags and the set of its parts with the last status of each."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    out = measures.first_and_set(table(spark, sf_dir, "lineitem"), "l_orderkey", order, ["l_returnflag", "l_suppkey"], "l_partkey", "l_linestatus")
    return out.select("l_orderkey", "l_returnflag", "l_suppkey", F.array_join("codes", ",").alias("codes"), F.array_join("labels", ",").alias("labels"))


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events of a user and type the last."""
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return query.last_per_key(df, ["user_id", "event_type"], ["ts", "event_id"])


def month_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by commune and year with the months covered."""
    df = table(spark, sf_dir, "dvf_mutations").where("date_mutation IS NOT NULL").groupBy(
        "code_commune", F.trunc("date_mutation", "month").alias("m")
    ).agg(F.count("*").alias("n_rows"))
    return measures.month_coverage(df, ["code_commune"], F.year("m"), F.month("m"), "n_rows")


def published_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the twelve months up to the last published one."""
    df = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = measures.published_month(df, F.trunc("day", "month"))
    return measures.rolling_year(df, "day", last).groupBy(F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n_orders"))


def territory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population-weighted profile by département, income known for a part of the communes."""
    df = table(spark, sf_dir, "communes").select(
        "code_departement", "population", F.when(F.col("population") % 3 != 0, F.col("population") % 1000 + 15_000).alias("income"),
        F.floor(F.col("population") / 4).alias("young"), F.floor(F.col("population") / 5).alias("old"),
    )
    return measures.weighted_profile(df, ["code_departement"], "population", "income", ["young", "old"])


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nurses per 100 000 residents by département against the whole."""
    people = table(spark, sf_dir, "annuaire_ameli").where("specialite_code = '24'").select("id", "code_departement").distinct()
    counts = people.groupBy("code_departement").agg(F.count("*").alias("n"))
    population = table(spark, sf_dir, "communes").groupBy("code_departement").agg(F.sum("population").alias("population"))
    return measures.rate_per(counts, population, "code_departement")


def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each source's latest snapshot as columns."""
    df = table(spark, sf_dir, "data_freshness").select("source", "snapshot_no", F.expr("stack(2, 'age', data_age_days, 'stale', staleness_days) AS (measure, value)"))
    return measures.latest_pivot(df.withColumn("ord", F.col("value")), ["source"], "snapshot_no", "measure", "value", "ord", ["age", "stale"])


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness by source over the logged attempts."""
    runs = table(spark, sf_dir, "data_freshness").distinct()
    return measures.freshness(
        runs, "source", "last_attempt_at", "last_attempt_status", F.col("data_age_days") <= 7, F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")
    )


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per provenance in one JSON object, greatest first."""
    counts = table(spark, sf_dir, "annuaire_ameli").groupBy("geom_source").agg(F.count("*").alias("n")).where("geom_source IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "geom_source")))
    as_map = F.map_from_entries(F.transform(ordered, lambda s: F.struct(s["geom_source"], -s["k"])))
    return counts.agg(F.to_json(as_map).alias("by_source"), F.sum("n").alias("total"))


def practitioners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per practitioner (name, first name, title, specialty and type) with the sites in id order."""
    keys = ["nom", "prenom", "civilite", "specialite_code", "type_ps_code"]
    df = table(spark, sf_dir, "annuaire_ameli").select(*keys, "id").distinct()
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), F.count("*").alias("n_sites"))


def histogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent spellings of the sale kinds."""
    df = table(spark, sf_dir, "dvf_mutations").groupBy("nature_mutation", "type_local").agg(F.count("*").alias("n"))
    return df.orderBy(F.desc("n"), F.asc_nulls_first("nature_mutation"), F.asc_nulls_first("type_local")).limit(5)


QUERIES = {
    "a01_count_cube": count_cube, "a02_cube_totals": cube_totals, "a04_nomenclature": nomenclature, "a06_group_centroids": group_centroids,
    "a09_price_statistics": price_statistics, "a09_sales_percentiles": sales_percentiles, "a11_first_wins_sets": first_wins_sets,
    "a12_last_write_wins": last_write_wins, "a13_month_coverage": month_coverage, "a14_published_year": published_year,
    "a17_territory_profile": territory_profile, "a19_densities": densities, "a20_latest_period": latest_period, "a21_freshness": freshness,
    "a24_json_report": json_report, "a27_practitioners": practitioners, "a29_histogram_top": histogram_top,
}

from bocage.plans.lookups import sql_metres, sql_point  # noqa: E402

_DIMS = "specialite_code, type_ps_code, secteur_conventionnel_code, code_departement, geom_source"

ORACLE = {
    "a01_count_cube": f"SELECT {_DIMS}, count(*) AS n FROM annuaire_ameli GROUP BY ALL",
    "a02_cube_totals": """SELECT count(*) AS n, 'infirmiers 01' AS scope FROM annuaire_ameli WHERE specialite_code = '24' AND code_departement = '01'
UNION ALL SELECT count(*), 'generalistes' FROM annuaire_ameli WHERE specialite_code = '01' UNION ALL SELECT 0, 'inconnu'""",
    "a04_nomenclature": """WITH l AS (SELECT specialite_code, max(specialite_libelle) AS libelle, count(*) AS n FROM annuaire_ameli
  WHERE specialite_code IS NOT NULL AND specialite_libelle IS NOT NULL GROUP BY 1)
SELECT specialite_code, CASE WHEN count(*) OVER (PARTITION BY libelle) > 1 THEN libelle || ' (code ' || specialite_code || ', ' || n || ')' ELSE libelle END AS label, n FROM l""",
    "a06_group_centroids": f"""WITH p AS (SELECT code_insee, {sql_point(1)} AS lon, {sql_point(2)} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address' AND code_insee IS NOT NULL)
SELECT code_insee, count(*) AS n_points, floor(sum(CAST(round(lon * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lon, floor(sum(CAST(round(lat * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lat
FROM p WHERE lon IS NOT NULL AND NOT (lon = 0 AND lat = 0) GROUP BY 1""",
    "a09_price_statistics": f"""WITH r AS (SELECT *, CASE WHEN isfinite(prix_m2) AND prix_m2 > 0 AND prix_m2 < 1e12 THEN prix_m2 END AS p FROM dvf_mutations WHERE {sql_metres("longitude", "latitude")} <= 25000)
SELECT count(*) AS n_rows, count(p) AS n_prices, count_if(surface_terrain > 0) AS n_lands, round(quantile_cont(p, 0.25), 4) AS p25, round(quantile_cont(p, 0.5), 4) AS p50,
  round(quantile_cont(p, 0.75), 4) AS p75, round(quantile_cont(surface_terrain, 0.5) FILTER (WHERE surface_terrain > 0), 4) AS median_land,
  min(date_mutation) AS first_day, max(date_mutation) AS last_day FROM r""",
    "a09_sales_percentiles": """WITH p AS (SELECT l_suppkey, l_extendedprice / l_quantity AS p, l_discount FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(quantile_cont(p, 0.25), 9) AS p25, round(quantile_cont(p, 0.5), 9) AS p50, round(quantile_cont(p, 0.75), 9) AS p75,
  round(quantile_cont(p, 0.5) FILTER (WHERE l_discount > 0.05), 9) AS median_discounted FROM p GROUP BY 1""",
    "a11_first_wins_sets": """WITH l AS (SELECT *, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS ord FROM lineitem),
f AS (SELECT l_orderkey, arg_min(l_returnflag, ord) AS l_returnflag, arg_min(l_suppkey, ord) AS l_suppkey FROM l GROUP BY 1),
p AS (SELECT l_orderkey, l_partkey, arg_max(l_linestatus, ord) AS s FROM l GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag, l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS codes, string_agg(s, ',' ORDER BY l_partkey) AS labels
FROM f JOIN p USING (l_orderkey) GROUP BY 1, 2, 3""",
    "a12_last_write_wins": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "a13_month_coverage": """WITH m AS (SELECT code_commune, date_trunc('month', date_mutation) AS m, count(*) AS n FROM dvf_mutations WHERE date_mutation IS NOT NULL GROUP BY 1, 2)
SELECT code_commune, year(m) AS year, CAST(sum(n) AS BIGINT) AS n_rows, bit_or(CAST(1 << (month(m) - 1) AS INT)) AS month_mask, bit_count(bit_or(CAST(1 << (month(m) - 1) AS INT))) AS n_months,
  count(*) - count(DISTINCT month(m)) AS n_repeats FROM m GROUP BY 1, 2""",
    "a14_published_year": """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT max(month) AS last FROM m WHERE n >= 0.5 * (SELECT max(n) FROM m))
SELECT month, n AS n_orders FROM m, l WHERE month <= last AND month > last - INTERVAL 12 MONTH""",
    "a17_territory_profile": """WITH c AS (SELECT code_departement, population, CASE WHEN population % 3 <> 0 THEN population % 1000 + 15000 END AS income, population // 4 AS young, population // 5 AS old FROM communes)
SELECT code_departement, CAST(sum(population) AS BIGINT) AS population, round(sum(young) / sum(population), 4) AS share_young, round(sum(old) / sum(population), 4) AS share_old,
  round(sum(population * income) FILTER (WHERE income IS NOT NULL) / nullif(sum(population) FILTER (WHERE income IS NOT NULL), 0), 2) AS mean_income,
  round(coalesce(sum(population) FILTER (WHERE income IS NOT NULL), 0) * 100.0 / sum(population), 1) AS covered_pct, count_if(income IS NULL) AS n_missing FROM c GROUP BY 1""",
    "a19_densities": """WITH c AS (SELECT code_departement, count(DISTINCT id) AS n FROM annuaire_ameli WHERE specialite_code = '24' AND id IS NOT NULL GROUP BY 1),
p AS (SELECT code_departement, CAST(sum(population) AS BIGINT) AS population FROM communes GROUP BY 1),
r AS (SELECT *, floor(n * 100000.0 / population * 100 + 0.5) / 100 AS rate, floor(sum(n) OVER () * 100000.0 / sum(population) OVER () * 100 + 0.5) / 100 AS national FROM c JOIN p USING (code_departement))
SELECT *, floor((rate - national) / national * 100 * 100 + 0.5) / 100 AS gap_pct FROM r""",
    "a20_latest_period": """WITH n AS (SELECT source, max(snapshot_no) AS snapshot_no FROM data_freshness GROUP BY 1)
SELECT source, snapshot_no, max(data_age_days) AS age, max(staleness_days) AS stale FROM data_freshness JOIN n USING (source, snapshot_no) GROUP BY 1, 2""",
    "a21_freshness": """WITH r AS (SELECT DISTINCT * FROM data_freshness)
SELECT source, max(last_attempt_at) AS last_attempt, arg_max(last_attempt_status, last_attempt_at) AS last_status,
  max(last_attempt_at) FILTER (WHERE last_attempt_status IN ('success', 'partial')) AS last_served,
  max(last_attempt_at) FILTER (WHERE last_attempt_status IN ('success', 'partial') AND data_age_days <= 7) AS last_change,
  CAST(floor(epoch(TIMESTAMP '2026-07-01') / 86400.0 - epoch(max(last_attempt_at) FILTER (WHERE last_attempt_status IN ('success', 'partial'))) / 86400.0) AS INT) AS served_days,
  CAST(floor(epoch(TIMESTAMP '2026-07-01') / 86400.0 - epoch(max(last_attempt_at) FILTER (WHERE last_attempt_status IN ('success', 'partial') AND data_age_days <= 7)) / 86400.0) AS INT) AS change_days
FROM r GROUP BY 1""",
    "a24_json_report": """WITH c AS (SELECT geom_source, count(*) AS n FROM annuaire_ameli WHERE geom_source IS NOT NULL GROUP BY 1)
SELECT '{' || string_agg('"' || geom_source || '":' || n, ',' ORDER BY n DESC, geom_source) || '}' AS by_source, CAST(sum(n) AS BIGINT) AS total FROM c""",
    "a27_practitioners": """SELECT nom, prenom, civilite, specialite_code, type_ps_code, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n_sites
FROM (SELECT DISTINCT nom, prenom, civilite, specialite_code, type_ps_code, id FROM annuaire_ameli) GROUP BY ALL""",
    "a29_histogram_top": """SELECT nature_mutation, type_local, count(*) AS n FROM dvf_mutations GROUP BY 1, 2
ORDER BY n DESC, nature_mutation NULLS FIRST, type_local NULLS FIRST LIMIT 5""",
}
