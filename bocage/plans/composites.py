"""Look-ups by id, rosters, area profiles, resolution cascades, panoramas and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import codes, geo, text
from bocage.operators import enrich, measures, profiles, proximity, quality, query
from bocage.operators.mappers import period_label
from bocage.plans import matching as matching_plans
from bocage.plans.cleaning import _LAT, _LON, sql_compare
from bocage.plans.lookups import LAT, LON, SQL_CENTRES, SQL_PLACED, sql_metres
from bocage.plans.problems import _SQL_INSIDE
from bocage.session import scratch_folder, table
from bocage.sources.store import Store


def facility_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres with the first and the last number of the list, and a number nobody has; at most a row each, warned of where there are more."""
    df = table(spark, sf_dir, "centres_sante").select("etab_finess", "etab_raison_sociale", "code_postal", "created_at")
    ends = df.agg(F.array(F.min("etab_finess"), F.max("etab_finess"), F.lit("000000000")).alias("k")).select(F.explode("k").alias("etab_finess"))
    return profiles.one_row_each(df, "etab_finess", ends, ["created_at", "etab_raison_sociale"]).drop("created_at")


def person_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered row of the last practitioner."""
    df = table(spark, sf_dir, "annuaire_ameli").select("id", "nom", "prenom", "adresse", "created_at")
    return df.join(df.agg(F.max("id").alias("id")), "id", "left_semi")


def facility_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practitioners at the point of each centre, in the order of speciality, name and first name."""
    centres = proximity.located(table(spark, sf_dir, "centres_sante"), F.col("etab_finess"), key_name="etab_finess")
    rows = table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address' AND id IS NOT NULL")
    people = query.with_point(rows).select("id", "specialite_code", "nom", "prenom", "lon", "lat").distinct()
    order = [F.col(c).asc_nulls_last() for c in ("specialite_code", "nom", "prenom", "id")]
    met = centres.join(people, ["lon", "lat"]).select("etab_finess", "id", "specialite_code", "nom", "prenom").distinct()
    return profiles.ranked(met, ["etab_finess"], order, 50)


def _areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Areas with their centre and measures derived from their code, and their shapes."""
    regions = table(spark, sf_dir, "iris").where(F.col("code_iris").rlike(codes.IRIS)).select(F.col("code_iris").alias("code"), "geom")
    rings = regions.select("code", geo.polygon_rings(F.col("geom")).alias("rings")).where(F.size("rings") > 0)
    centre = lambda c: (F.floor(F.sum(F.round(F.col(f"p.{c}") * 1e6).cast("long")) / F.count("*") + 0.5) / 1e6).alias({"x": "lon", "y": "lat"}[c])
    spots = rings.distinct().select("code", F.explode(F.flatten("rings")).alias("p")).groupBy("code").agg(centre("x"), centre("y"))
    number = F.substring("code", 3, 7).cast("long")
    population = number % 2900 + 100
    areas = spots.withColumns(
        {
            "population": population, "income": F.when(number % 3 != 0, number % 20_000 + 12_000), "young": F.floor(population / 4), "old": F.floor(population / 5),
        }
    )
    return areas, regions


def area_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by code and by point, of an area, a commune, a département and of basins."""
    areas, regions = _areas(spark, sf_dir)
    asked = {
        "point": {"point": (LON, LAT)}, "point_basin": {"point": (LON, LAT), "radius_m": 30_000.0}, "commune": {"code": "67939"},
        "department": {"code": "01"}, "commune_basin": {"code": "67939", "radius_m": 40_000.0},
    }
    out = None
    for name, how in asked.items():
        one = profiles.area_profile(areas, regions, **how).withColumn("asked", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population of an area, a commune, a département and the country, by the length of the code."""
    areas, _ = _areas(spark, sf_dir)
    out = None
    for code in ("679390000", "67939", "01", "FR"):
        one = profiles.population_by(areas, code)
        out = one if out is None else out.unionByName(one)
    return out


def hosted_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities hosted by the centres within 60 km: how many, and the first three by name."""
    near = query.last_near(
        table(spark, sf_dir, "centres_sante").select("etab_finess", "etab_raison_sociale", "specialites_codes", "geom", "created_at"),
        ["etab_finess"], ["created_at", "geom"], LON, LAT, 60_000.0,
    )
    hosted = near.select("etab_finess", "etab_raison_sociale", F.explode("specialites_codes").alias("code")).distinct()
    order = [F.col("etab_raison_sociale").asc_nulls_last(), F.col("etab_finess")]
    first = profiles.ranked(hosted, ["code"], order, 3).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rank", "etab_finess"))).alias("s"))
    totals = hosted.groupBy("code").agg(F.count("*").alias("n_total"))
    return totals.join(first, "code").select("code", "n_total", F.array_join(F.transform("s", lambda x: x["etab_finess"]), ",").alias("sample"))


def zones_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of a kind by prefix whose centre lies within 120 km of a point, those of the strict kind marked."""
    areas, _ = _areas(spark, sf_dir)
    kinds = table(spark, sf_dir, "iris").where(F.col("code_iris").rlike(codes.IRIS)).groupBy(F.col("code_iris").alias("code")).agg(F.max("type_iris").alias("kind"))
    near = query.in_radius(areas.select("code", "lon", "lat"), LON, LAT, 120_000.0).join(kinds, "code").where(F.col("kind").startswith("D") | F.col("kind").startswith("A"))
    return near.select("code", "kind", (F.col("kind") == "A").alias("immediate"), F.round("distance_m", 3).alias("distance_m"))


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best establishments of each centre by score, name score and number."""
    pairs = matching_plans.reconciliations(spark, sf_dir)
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("score_name"), F.col("siret")]
    return profiles.ranked(pairs, ["etab_finess"], order, 3).select("etab_finess", "siret", "score", "score_name", "rank")


def site_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The establishment of each centre through the gates of address, name, owner and lead."""
    pairs = matching_plans.reconciliations(spark, sf_dir)
    owners = table(spark, sf_dir, "sirene_etablissements").groupBy("siret").agg(F.max("siren").alias("siren"))
    return profiles.resolved(pairs.join(owners, "siret"), "etab_finess", "siret", "siren", "score", "score_name", "score_address")


def _last_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text.compare_key(F.concat_ws(" ", "numero_voie", "type_voie", "libelle_voie"))
    df = table(spark, sf_dir, "sirene_etablissements").select("siret", "siren", "actif", "date_creation", "date_fermeture", "code_commune", line.alias("line"), "date_maj")
    return query.last_per_key(df, ["siret"], ["date_maj", "actif", "line"])


def site_successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed establishments and the one of another owner that came to the same street and commune after them."""
    sites = _last_sites(spark, sf_dir).withColumn("street", F.regexp_replace("line", "^[0-9]+ ?", "")).where("street <> ''")
    return profiles.successions(sites, ["code_commune", "street"], "siret", "siren", "actif", "date_creation", "date_fermeture")


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each centre against the names the directory gives at its point."""
    centres = proximity.located(table(spark, sf_dir, "centres_sante"), F.struct("etab_finess", "etab_raison_sociale"), key_name="k")
    mine = table(spark, sf_dir, "centres_sante").select("etab_finess", "etab_raison_sociale").where("etab_finess IS NOT NULL")
    people = query.with_point(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'")).select("raison_sociale", "lon", "lat").distinct()
    others = centres.join(people, ["lon", "lat"]).select("k.etab_finess", "raison_sociale")
    return profiles.name_comparison(mine, "etab_finess", text.compare_key(F.col("etab_raison_sociale")), others, F.nullif(text.compare_key(F.col("raison_sociale")), F.lit("")))


def establishment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names and well-formed numbers of each legal unit; blank and sentinel names drop."""
    df = table(spark, sf_dir, "sirene_etablissements").where("siren IS NOT NULL")
    name = F.explode(F.array("raison_sociale_unite_legale", "denomination_usuelle", "enseigne")).alias("name")
    names = df.select("siren", name).select("siren", F.trim("name").alias("name")).where("name <> '' AND lower(name) <> '_unknown_'")
    a = names.groupBy("siren").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))
    b = df.where(codes.valid(F.col("siret"), codes.SIRET)).groupBy("siren").agg(F.array_join(F.array_sort(F.collect_set("siret")), "|").alias("sirets"))
    return a.join(b, "siren", "full")


def site_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each centre with its verdict, the state of its establishment and its practitioners."""
    sites = _last_sites(spark, sf_dir).select("siret", "siren", "date_creation")
    people = facility_roster(spark, sf_dir).groupBy("etab_finess").agg(F.count("*").alias("n_people"))
    names = table(spark, sf_dir, "centres_sante").where("etab_finess IS NOT NULL").select("etab_finess").distinct()
    out = names.join(site_resolution(spark, sf_dir), "etab_finess", "left").join(sites, "siret", "left").join(people, "etab_finess", "left")
    return out.select("etab_finess", F.coalesce("status", F.lit("none")).alias("status"), "siret", "date_creation", F.coalesce("n_people", F.lit(0)).alias("n_people"))


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other centres within 3 km of each, with whether they belong to a group of several sites."""
    centres = proximity.located(table(spark, sf_dir, "centres_sante"), F.col("etab_finess"))
    near = proximity.near_pairs(centres, centres, 3000.0).where("left_key <> right_key")
    three = profiles.ranked(near, ["left_key"], [F.col("metres"), F.col("right_key")], 3)
    owners = table(spark, sf_dir, "sirene_etablissements").where("siret IS NOT NULL").groupBy("siren").agg(F.countDistinct("siret").alias("n_sites"))
    found = site_resolution(spark, sf_dir).join(_last_sites(spark, sf_dir).select("siret", "siren"), "siret").join(owners, "siren").select(F.col("etab_finess").alias("right_key"), "n_sites")
    out = three.join(found, "right_key", "left")
    return out.select(
        F.col("left_key").alias("etab_finess"), F.col("right_key").alias("competitor"), "rank", F.round("metres", 3).alias("metres"), F.coalesce(F.col("n_sites") >= 2, F.lit(False)).alias("in_group")
    )


def implantation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a study around a point, each with its size, status and whether a list of 100 would be cut."""
    here = lambda df, m: query.in_radius(query.with_point(df), LON, LAT, m)
    areas, _ = _areas(spark, sf_dir)
    people = here(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'"), 10_000.0).select("id").distinct()
    sales = query.in_radius(table(spark, sf_dir, "dvf_mutations").withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")}), LON, LAT, 10_000.0)
    towns = query.in_radius(table(spark, sf_dir, "communes"), LON, LAT, 30_000.0)
    sections = {
        "people": people, "centres": here(table(spark, sf_dir, "centres_sante"), 30_000.0).select("etab_finess").distinct(), "sales": sales,
        "areas": query.in_radius(areas, LON, LAT, 30_000.0), "communes": towns,
        "sites": table(spark, sf_dir, "sirene_etablissements").where("actif").join(towns.select(F.col("code_insee").alias("code_commune")), "code_commune", "left_semi").select("siret").distinct(),
        "freshness": table(spark, sf_dir, "data_freshness").where("source IS NOT NULL").select("source").distinct(),
    }
    out = None
    for name, df in sections.items():
        one = profiles.section(df, name, 100)
        out = one if out is None else out.unionByName(one)
    return out


def market_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a study of the market: communes with full years of sales, zones and sales near a point."""
    df = table(spark, sf_dir, "dvf_mutations")
    years = df.where("date_mutation IS NOT NULL").groupBy("code_commune", F.year("date_mutation").alias("y")).agg(F.countDistinct(F.month("date_mutation")).alias("m"))
    sales = query.in_radius(df.withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")}), LON, LAT, 25_000.0)
    out = profiles.section(years.where("m = 12").select("code_commune").distinct(), "full_years", 1000)
    return out.unionByName(profiles.section(zones_near(spark, sf_dir), "zones", 100)).unionByName(profiles.section(sales, "sales", 1000))


def permit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: the gate of a monthly table: communes, invalid codes, yearly totals, years short of months, and how late it is."""
    df = table(spark, sf_dir, "dvf_mutations")
    rules = [
        quality.Rule("communes", F.countDistinct("code_commune"), 500, None),
        quality.Rule("invalid", quality.rate(~codes.valid(F.col("code_commune"), codes.INSEE)), None, 0.001),
        quality.Rule("months_late", F.max(F.lit(2026 * 12 + 12)) - F.max(F.year("date_mutation") * 12 + F.month("date_mutation")), None, 4, "partial"),
    ]
    years = df.where("date_mutation IS NOT NULL").groupBy(F.year("date_mutation").alias("y")).agg(F.count("*").alias("n"), F.countDistinct(F.month("date_mutation")).alias("m"))
    yearly = [
        quality.Rule("least_year", F.min(F.when(F.col("m") == 12, F.col("n"))), 100, None), quality.Rule("short_years", quality.rate(F.col("m") < 12), None, 0.5, "warning"),
    ]
    return quality.evaluate(df, rules).unionByName(quality.evaluate(years, yearly))


def diff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules between the directory's rows with odd months of delivery and all of them."""
    rows = query.with_point(table(spark, sf_dir, "annuaire_ameli"))
    old = rows.where(F.month("created_at") % 2 == 1).select("id", "lon", "lat")
    return quality.diff_rules(enrich.generation_diff(rows.select("id", "lon", "lat"), old, "id", 500.0))


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty keys to look up with what remains; old rejections get a fourth try."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    cache = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 3 != 0).alias("accepted"), (F.col("s_suppkey") % 5).cast("int").alias("attempts"), (F.col("s_nationkey") < 12).alias("old")
    )
    return quality.work_queue(quality.work_selection(keys, cache, "k", stale=F.col("old")), "k", 60)


def work_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct address keys that qualify for a look-up, and those the cache lacks."""
    eligible = F.col("adresse").rlike("[A-Za-z]") & F.col("code_postal").rlike(r"^\d{5}\z")
    keys = table(spark, sf_dir, "annuaire_ameli").where(eligible).select(text.address_key(F.col("adresse"), F.col("code_postal"), F.col("ville")).alias("k")).distinct()
    cached = table(spark, sf_dir, "centres_sante").select(text.address_key(F.col("voie"), F.col("code_postal"), F.col("ville")).alias("k")).distinct()
    return keys.join(cached.withColumn("hit", F.lit(1)), "k", "left").agg(F.count("*").alias("n_eligible"), F.count_if(F.col("hit").isNull()).alias("n_to_do"))


def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practitioners of each département by family of speciality, the families being a dimension of their own."""
    df = table(spark, sf_dir, "annuaire_ameli").select("id", "specialite_code", "code_departement").distinct()
    families = df.where("specialite_code IS NOT NULL").select("specialite_code").distinct().withColumn(
        "family", F.when(F.col("specialite_code") < "19", "medecins").when(F.col("specialite_code") < "24", "dentaire").otherwise("paramedicaux")
    )
    return df.join(families, "specialite_code").groupBy("code_departement", "family").agg(F.countDistinct("id").alias("n"))


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years the sales of each commune span."""
    df = table(spark, sf_dir, "dvf_mutations").where("date_mutation IS NOT NULL").groupBy("code_commune").agg(F.min("date_mutation").alias("a"), F.max("date_mutation").alias("b"))
    return df.select("code_commune", period_label(F.col("a"), F.col("b")).alias("period"))


def message_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names shortened for a message and written as delimited values."""
    df = table(spark, sf_dir, "annuaire_ameli").select("id", "adresse").distinct()
    return df.select("id", text.shortened(F.col("adresse"), 12).alias("short"), text.csv_value(F.col("adresse")).alias("csv"))


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points computed once at write, rows clustered by cell; the radius is then a range the scan prunes by."""
    rows = query.with_point(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'")).select("id", "lon", "lat").distinct()
    store = Store(scratch_folder(spark, "points"))
    cells = rows.withColumns({"band": F.floor("lat"), "column": F.floor("lon")})
    store.publish(spark, "people_points", store.stage(cells, "people_points", sort=("band", "column", "lat", "lon")))
    near = query.in_radius(store.read(spark, "people_points"), LON, LAT, 20_000.0)
    return near.select("id", F.round("distance_m", 3).alias("distance_m"))


def site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of each département as one feature collection, its size and the order of its keys."""
    rows = query.with_point(table(spark, sf_dir, "centres_sante").where("etab_finess IS NOT NULL")).select("etab_finess", "code_departement", "lon", "lat").distinct()
    one = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("etab_finess").alias("properties")
    )
    per = rows.groupBy("code_departement").agg(F.array_sort(F.collect_list(F.struct("etab_finess", one.alias("f")))).alias("s"), F.count("*").alias("n"))
    whole = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("s", lambda x: x["f"]).alias("features")))
    return per.select("code_departement", "n", F.get_json_object(whole, "$.features[0].properties.etab_finess").alias("first"), F.get_json_object(whole, "$.type").alias("kind"))


QUERIES = {
    "c03_facility_by_id": facility_by_id, "c10_person_by_id": person_by_id, "c08_facility_roster": facility_roster, "c14_area_profiles": area_profiles,
    "c15_populations": populations, "c17_hosted_activities": hosted_activities, "c21_zones_near": zones_near, "t09_ranked_candidates": ranked_candidates,
    "c23_site_resolution": site_resolution, "c25_successions": site_successions, "c27_company_names": company_names, "a28_establishment_names": establishment_names,
    "c37_site_inspection": site_inspection, "c36_competitors": competitors, "c35_implantation": implantation, "c22_market_study": market_study, "q08_permit_gate": permit_gate, "q06_diff_gate": diff_gate,
    "q13_work_queue": work_queue, "a26_work_counts": work_counts, "a23_family_counts": family_counts, "proj23_period_labels": period_labels,
    "x16_message_values": message_values, "proj14_stored_points": stored_points, "n03_site_features": site_features,
}

_RECONCILED = matching_plans.ORACLE["c29_reconciliations"]
_SPOT = r"""try_cast(regexp_split_to_array(trim(p), '\s+')[{}] AS DOUBLE)"""
_AREAS = rf"""shaped AS (SELECT DISTINCT code_iris AS code, geom FROM iris WHERE regexp_full_match(code_iris, '(\d{{2}}|2A|2B)\d{{7}}') AND regexp_matches(geom, 'POLYGON')),
ring AS (SELECT code, unnest(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) AS r FROM shaped), vert AS (SELECT code, unnest(string_split(r, ',')) AS p FROM ring),
spots AS (SELECT code, floor(sum(CAST(round({_SPOT.format(1)} * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lon, floor(sum(CAST(round({_SPOT.format(2)} * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lat FROM vert GROUP BY 1),
numbered AS (SELECT *, CAST(code[3:9] AS BIGINT) AS num FROM spots),
areas AS (SELECT code, lon, lat, num % 2900 + 100 AS population, CASE WHEN num % 3 <> 0 THEN num % 20000 + 12000 END AS income, (num % 2900 + 100) // 4 AS young, (num % 2900 + 100) // 5 AS old FROM numbered)"""


def _sql_profile(asked: str, scope: str, rows: str) -> str:
    return f"""SELECT '{scope}' AS scope, CAST(sum(population) AS BIGINT) AS population, round(sum(young) / sum(population), 4) AS share_young, round(sum(old) / sum(population), 4) AS share_old,
  round(sum(population * income) FILTER (WHERE income IS NOT NULL) / nullif(sum(population) FILTER (WHERE income IS NOT NULL), 0), 2) AS mean_income,
  round(coalesce(sum(population) FILTER (WHERE income IS NOT NULL), 0) * 100.0 / sum(population), 1) AS covered_pct, count_if(income IS NULL) AS n_missing, count(*) AS n_areas, '{asked}' AS asked
FROM ({rows}) HAVING count(*) > 0"""


def _sql_between(x0: str, y0: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - {y0}) / 2), 2) + cos(radians({y0})) * cos(radians(lat)) * pow(sin(radians(lon - {x0}) / 2), 2))))"


_CROSSED = f"""SELECT * FROM areas WHERE code IN (SELECT code_iris FROM (
  SELECT code_iris, p[i][1] AS x1, p[i][2] AS y1, p[i % len(p) + 1][1] AS x2, p[i % len(p) + 1][2] AS y2, shape FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pts)) e
  GROUP BY code_iris, shape HAVING sum(CASE WHEN (y1 > {LAT}) <> (y2 > {LAT}) AND {LON} < (x2 - x1) * ({LAT} - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"""
_LAST_SITES = f"""sites AS (SELECT siret, siren, actif, date_creation, date_fermeture, code_commune, {sql_compare(matching_plans._SITE_LINE)} AS line FROM sirene_etablissements
  QUALIFY row_number() OVER (PARTITION BY siret ORDER BY date_maj DESC NULLS LAST, actif DESC, {sql_compare(matching_plans._SITE_LINE)} DESC) = 1)"""
_RESOLVED = f"""recon AS ({_RECONCILED}), owned AS (SELECT r.*, o.siren FROM recon r JOIN (SELECT siret, max(siren) AS siren FROM sirene_etablissements GROUP BY 1) o USING (siret)),
ok AS (SELECT *, max(score) OVER (PARTITION BY etab_finess) AS top FROM owned WHERE score_address >= 0.6 AND score_name >= 0.2),
lead1 AS (SELECT etab_finess, count(DISTINCT siren) AS owners, count(DISTINCT siren) FILTER (WHERE score = top) AS tied, max(row(score, score_name, siret)) AS b FROM ok GROUP BY 1),
resolved AS (SELECT a.etab_finess, CASE WHEN owners IS NULL THEN 'none' WHEN owners = 1 THEN 'resolved' WHEN tied = 1 THEN 'leading' ELSE 'ambiguous' END AS status,
  CASE WHEN owners = 1 OR tied = 1 THEN b[3] END AS siret FROM (SELECT DISTINCT etab_finess FROM owned) a LEFT JOIN lead1 USING (etab_finess))"""
_ROSTER = f"""c8 AS (SELECT DISTINCT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante WHERE etab_finess IS NOT NULL),
p8 AS (SELECT DISTINCT id, specialite_code, nom, prenom, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address' AND id IS NOT NULL),
m8 AS (SELECT DISTINCT etab_finess, id, specialite_code, nom, prenom FROM c8 JOIN p8 USING (lon, lat) WHERE NOT (lon = 0 AND lat = 0)),
roster AS (SELECT *, row_number() OVER (PARTITION BY etab_finess ORDER BY specialite_code NULLS LAST, nom NULLS LAST, prenom NULLS LAST, id) AS rank FROM m8 QUALIFY rank <= 50)"""
_KEY = lambda f: f"upper(trim(regexp_replace(regexp_replace(coalesce({f}, ''), '\\bCEDEX[ \\t\\n\\x0B\\f\\r]*\\d*', ' ', 'gi'), '[ \\t\\n\\x0B\\f\\r\\x{{00A0}}]+', ' ', 'g')))"
_RULE = "SELECT '{}' AS rule, '{}' AS severity, v AS value, CAST({} AS DOUBLE) AS low, CAST({} AS DOUBLE) AS high, {} AS ok FROM (SELECT round(CAST({} AS DOUBLE), 6) AS v FROM {})"

ORACLE = {
    "c03_facility_by_id": """WITH w AS (SELECT unnest([min(etab_finess), max(etab_finess), '000000000']) AS etab_finess FROM centres_sante),
r AS (SELECT DISTINCT etab_finess, etab_raison_sociale, code_postal, created_at FROM centres_sante),
b AS (SELECT etab_finess, count(*) AS n_rows, max(row(created_at, etab_raison_sociale, code_postal)) AS m FROM r GROUP BY 1)
SELECT w.etab_finess, m[2] AS etab_raison_sociale, m[3] AS code_postal, coalesce(n_rows, 0) AS n_rows, coalesce(n_rows, 0) > 1 AS several FROM w LEFT JOIN b USING (etab_finess)""",
    "c10_person_by_id": "SELECT id, nom, prenom, adresse, created_at FROM annuaire_ameli WHERE id = (SELECT max(id) FROM annuaire_ameli)",
    "c08_facility_roster": f"WITH {_ROSTER} SELECT * FROM roster",
    "c14_area_profiles": f"""{"WITH " + _SQL_INSIDE.lstrip()}, {_AREAS}
{_sql_profile("point", "area", _CROSSED)} UNION ALL {_sql_profile("point_basin", "basin", f"SELECT * FROM areas WHERE {sql_metres('lon', 'lat')} <= 30000")}
UNION ALL {_sql_profile("commune", "area", "SELECT * FROM areas WHERE code LIKE '67939%'")} UNION ALL {_sql_profile("department", "area", "SELECT * FROM areas WHERE code LIKE '01%'")}
UNION ALL {_sql_profile("commune_basin", "basin", f"SELECT areas.* FROM areas, (SELECT avg(lon) AS x0, avg(lat) AS y0 FROM areas WHERE code LIKE '67939%') WHERE {_sql_between('x0', 'y0')} <= 40000")}""",
    "c15_populations": f"WITH {_AREAS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS code, '{level}' AS level, CAST(sum(population) AS BIGINT) AS population, count(*) AS n_areas FROM areas WHERE {where}"
        for c, level, where in (("679390000", "area", "code = '679390000'"), ("67939", "commune", "code LIKE '67939%'"), ("01", "department", "code LIKE '01%'"), ("FR", "country", "true"))
    ),
    "c17_hosted_activities": f"""WITH {SQL_CENTRES}, near AS (SELECT *, {sql_metres("lon", "lat")} AS m FROM centres WHERE lon IS NOT NULL AND NOT (lon = 0 AND lat = 0)),
h AS (SELECT DISTINCT etab_finess, etab_raison_sociale, code FROM (SELECT etab_finess, etab_raison_sociale, unnest(specialites_codes) AS code FROM near WHERE m <= 60000)),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY etab_raison_sociale NULLS LAST, etab_finess) AS k FROM h)
SELECT code, count(*) AS n_total, string_agg(etab_finess, ',' ORDER BY k) FILTER (WHERE k <= 3) AS sample FROM r GROUP BY 1""",
    "c21_zones_near": f"""WITH {_AREAS}, k AS (SELECT code_iris AS code, max(type_iris) AS kind FROM iris GROUP BY 1)
SELECT code, kind, kind = 'A' AS immediate, round({sql_metres("lon", "lat")}, 3) AS distance_m FROM areas JOIN k USING (code) WHERE (kind LIKE 'D%' OR kind LIKE 'A%') AND {sql_metres("lon", "lat")} <= 120000""",
    "t09_ranked_candidates": f"""WITH recon AS ({_RECONCILED}) SELECT etab_finess, siret, score, score_name, row_number() OVER (PARTITION BY etab_finess ORDER BY score DESC NULLS LAST, score_name DESC NULLS LAST, siret) AS rank
FROM recon QUALIFY rank <= 3""",
    "c23_site_resolution": f"WITH {_RESOLVED} SELECT * FROM resolved",
    "c25_successions": f"""WITH {_LAST_SITES}, s AS (SELECT *, regexp_replace(line, '^[0-9]+ ?', '') AS street FROM sites)
SELECT a.code_commune, a.street, a.siret AS before, a.date_fermeture, b.siret AS after, b.date_creation FROM s a JOIN s b ON a.code_commune = b.code_commune AND a.street = b.street
WHERE a.street <> '' AND NOT a.actif AND a.date_fermeture IS NOT NULL AND b.actif AND a.siren <> b.siren AND b.date_creation >= a.date_fermeture
QUALIFY row_number() OVER (PARTITION BY a.siret ORDER BY b.date_creation, b.siret) = 1""",
    "c27_company_names": f"""WITH c AS (SELECT DISTINCT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante WHERE etab_finess IS NOT NULL), o AS (SELECT DISTINCT etab_finess, {sql_compare("etab_raison_sociale")} AS own FROM centres_sante WHERE etab_finess IS NOT NULL),
p AS (SELECT DISTINCT nullif({sql_compare("raison_sociale")}, '') AS n, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address'),
k AS (SELECT DISTINCT etab_finess, n FROM c JOIN p USING (lon, lat) WHERE n IS NOT NULL AND NOT (lon = 0 AND lat = 0))
SELECT etab_finess, CASE WHEN bool_or(coalesce(n = own, false)) FILTER (WHERE n IS NOT NULL) IS NULL THEN 'absent' WHEN bool_or(coalesce(n = own, false)) THEN 'exact_match' ELSE 'divergent' END AS verdict
FROM o LEFT JOIN k USING (etab_finess) GROUP BY 1""",
    "a28_establishment_names": r"""WITH n AS (SELECT DISTINCT siren, trim(name) AS name FROM (SELECT siren, unnest([raison_sociale_unite_legale, denomination_usuelle, enseigne]) AS name FROM sirene_etablissements WHERE siren IS NOT NULL)),
a AS (SELECT siren, string_agg(name, '|' ORDER BY name) AS names FROM n WHERE name <> '' AND lower(name) <> '_unknown_' GROUP BY 1),
b AS (SELECT siren, string_agg(DISTINCT siret, '|' ORDER BY siret) AS sirets FROM sirene_etablissements WHERE siren IS NOT NULL AND regexp_full_match(siret, '\d{14}') GROUP BY 1)
SELECT siren, names, sirets FROM a FULL JOIN b USING (siren)""",
    "c37_site_inspection": f"""WITH {_RESOLVED}, {_LAST_SITES}, {_ROSTER}, n AS (SELECT etab_finess, count(*) AS n_people FROM roster GROUP BY 1)
SELECT c.etab_finess, coalesce(status, 'none') AS status, r.siret, date_creation, coalesce(n_people, 0) AS n_people FROM (SELECT DISTINCT etab_finess FROM centres_sante WHERE etab_finess IS NOT NULL) c
LEFT JOIN resolved r USING (etab_finess) LEFT JOIN sites s ON s.siret = r.siret LEFT JOIN n USING (etab_finess)""",
    "c36_competitors": f"""WITH {_RESOLVED}, {_LAST_SITES}, c AS (SELECT DISTINCT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante WHERE etab_finess IS NOT NULL AND {_LON} IS NOT NULL AND NOT ({_LON} = 0 AND {_LAT} = 0)),
d AS (SELECT a.etab_finess, b.etab_finess AS competitor, min(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) AS m
  FROM c a JOIN c b ON a.etab_finess <> b.etab_finess AND abs(a.lat - b.lat) < 0.05 GROUP BY 1, 2 HAVING m <= 3000),
t AS (SELECT *, row_number() OVER (PARTITION BY etab_finess ORDER BY m, competitor) AS rank FROM d QUALIFY rank <= 3),
g AS (SELECT siren, count(DISTINCT siret) AS n_sites FROM sirene_etablissements WHERE siret IS NOT NULL GROUP BY 1)
SELECT t.etab_finess, competitor, rank, round(m, 3) AS metres, coalesce(n_sites >= 2, false) AS in_group FROM t LEFT JOIN resolved r ON r.etab_finess = competitor LEFT JOIN sites s ON s.siret = r.siret LEFT JOIN g ON g.siren = s.siren""",
    "c35_implantation": f"""WITH {_AREAS}, pl AS (SELECT id, geom_source, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli), ce AS (SELECT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante),
tw AS (SELECT code_insee FROM communes WHERE {sql_metres("lon", "lat")} <= 30000), s AS (
SELECT 'people' AS section, count(DISTINCT id) AS n FROM pl WHERE geom_source = 'ban_address' AND {sql_metres("lon", "lat")} <= 10000 AND NOT (lon = 0 AND lat = 0)
UNION ALL SELECT 'centres', count(DISTINCT etab_finess) FROM ce WHERE {sql_metres("lon", "lat")} <= 30000 AND NOT (lon = 0 AND lat = 0)
UNION ALL SELECT 'sales', count(*) FROM dvf_mutations WHERE {sql_metres("longitude", "latitude")} <= 10000 UNION ALL SELECT 'areas', count(*) FROM areas WHERE {sql_metres("lon", "lat")} <= 30000
UNION ALL SELECT 'communes', count(*) FROM tw UNION ALL SELECT 'sites', count(DISTINCT siret) FROM sirene_etablissements WHERE actif AND code_commune IN (SELECT code_insee FROM tw)
UNION ALL SELECT 'freshness', count(DISTINCT source) FROM data_freshness)
SELECT section, n, n > 100 AS truncated, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status FROM s""",
    "c22_market_study": f"""WITH {_AREAS}, k AS (SELECT code_iris AS code, max(type_iris) AS kind FROM iris GROUP BY 1),
y AS (SELECT code_commune FROM dvf_mutations WHERE date_mutation IS NOT NULL GROUP BY code_commune, year(date_mutation) HAVING count(DISTINCT month(date_mutation)) = 12),
s AS (SELECT 'full_years' AS section, (SELECT count(*) FROM (SELECT DISTINCT code_commune FROM y)) AS n, 1000 AS most
UNION ALL SELECT 'zones', count(*), 100 FROM areas JOIN k USING (code) WHERE (kind LIKE 'D%' OR kind LIKE 'A%') AND {sql_metres("lon", "lat")} <= 120000
UNION ALL SELECT 'sales', count(*), 1000 FROM dvf_mutations WHERE {sql_metres("longitude", "latitude")} <= 25000)
SELECT section, n, n > most AS truncated, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status FROM s""",
    "q08_permit_gate": "WITH t AS (SELECT * FROM dvf_mutations), y AS (SELECT year(date_mutation) AS y, count(*) AS n, count(DISTINCT month(date_mutation)) AS m FROM dvf_mutations WHERE date_mutation IS NOT NULL GROUP BY 1) "
    + " UNION ALL ".join(
        [
            _RULE.format("communes", "fatal", 500, "NULL", "v >= 500", "count(DISTINCT code_commune)", "t"),
            _RULE.format("invalid", "fatal", "NULL", 0.001, "v <= 0.001", "count_if(NOT coalesce(regexp_full_match(code_commune, '[0-9][0-9AB][0-9]{3}'), false)) / count(*)", "t"),
            _RULE.format("months_late", "partial", "NULL", 4, "v <= 4", "2026 * 12 + 12 - max(year(date_mutation) * 12 + month(date_mutation))", "t"),
            _RULE.format("least_year", "fatal", 100, "NULL", "v >= 100", "min(n) FILTER (WHERE m = 12)", "y"),
            _RULE.format("short_years", "warning", "NULL", 0.5, "v <= 0.5", "count_if(m < 12) / count(*)", "y"),
        ]
    ),
    "q06_diff_gate": f"""WITH r AS (SELECT id, created_at, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli), p AS (SELECT * FROM r WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0)),
a AS (SELECT id, max(row(lon, lat)) AS n FROM p GROUP BY 1), b AS (SELECT id, max(row(lon, lat)) AS o FROM p WHERE month(created_at) % 2 = 1 GROUP BY 1),
c AS (SELECT count_if(b.id IS NULL) AS added, count_if(a.id IS NULL) AS removed, count_if(a.id IS NOT NULL AND b.id IS NOT NULL) AS kept,
  count_if(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(o[2] - n[2]) / 2), 2) + cos(radians(n[2])) * cos(radians(o[2])) * pow(sin(radians(o[1] - n[1]) / 2), 2)))) > 500) AS moved FROM a FULL JOIN b USING (id))
"""
    + " UNION ALL ".join(
        [
            _RULE.format("coverage", "fatal", 0.95, "NULL", "v >= 0.95", "coalesce((kept + added) / nullif(kept + removed, 0), 1)", "c"),
            _RULE.format("removed", "fatal", "NULL", 0.10, "v <= 0.10", "coalesce(removed / nullif(kept + removed, 0), 0)", "c"),
            _RULE.format("lost_point", "fatal", "NULL", 0.005, "v <= 0.005", "0", "c"),
            _RULE.format("moved", "warning", "NULL", 0.20, "v <= 0.20", "coalesce(moved / nullif(kept, 0), 0)", "c"),
        ]
    ),
    "q13_work_queue": """WITH w AS (SELECT c_custkey AS k, CAST(coalesce(s_suppkey % 5, 0) AS INT) AS attempts FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
WHERE s_suppkey IS NULL OR (s_suppkey % 3 = 0 AND (s_suppkey % 5 < 3 OR (s_nationkey < 12 AND s_suppkey % 5 < 4))))
SELECT k, attempts, greatest((SELECT count(*) FROM w) - 60, 0) AS remaining FROM w ORDER BY attempts, k LIMIT 60""",
    "a26_work_counts": f"""WITH k AS (SELECT DISTINCT {_KEY("adresse")} || '|' || {_KEY("code_postal")} || '|' || {_KEY("ville")} AS k FROM annuaire_ameli WHERE regexp_matches(adresse, '[A-Za-z]') AND regexp_full_match(code_postal, '\\d{{5}}')),
c AS (SELECT DISTINCT {_KEY("voie")} || '|' || {_KEY("code_postal")} || '|' || {_KEY("ville")} AS k FROM centres_sante)
SELECT count(*) AS n_eligible, count_if(c.k IS NULL) AS n_to_do FROM k LEFT JOIN c USING (k)""",
    "a23_family_counts": """SELECT code_departement, CASE WHEN specialite_code < '19' THEN 'medecins' WHEN specialite_code < '24' THEN 'dentaire' ELSE 'paramedicaux' END AS family, count(DISTINCT id) AS n
FROM annuaire_ameli WHERE specialite_code IS NOT NULL GROUP BY 1, 2""",
    "proj23_period_labels": """SELECT code_commune, CASE WHEN min(year(date_mutation)) = max(year(date_mutation)) THEN CAST(min(year(date_mutation)) AS VARCHAR) ELSE min(year(date_mutation)) || '–' || max(year(date_mutation)) END AS period
FROM dvf_mutations WHERE date_mutation IS NOT NULL GROUP BY 1""",
    "x16_message_values": r"""SELECT DISTINCT id, CASE WHEN length(adresse) <= 12 THEN adresse ELSE adresse[1:11] || '…' END AS short,
  coalesce(CASE WHEN regexp_matches(adresse, '[,"\n\r]') THEN '"' || replace(adresse, '"', '""') || '"' ELSE adresse END, '') AS csv FROM annuaire_ameli""",
    "proj14_stored_points": f"""WITH p AS (SELECT DISTINCT id, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address')
SELECT id, round({sql_metres("lon", "lat")}, 3) AS distance_m FROM p WHERE {sql_metres("lon", "lat")} <= 20000 AND NOT (lon = 0 AND lat = 0)""",
    "n03_site_features": f"""WITH p AS (SELECT DISTINCT etab_finess, code_departement, {_LON} AS lon, {_LAT} AS lat FROM centres_sante WHERE etab_finess IS NOT NULL)
SELECT code_departement, count(*) AS n, min(etab_finess) AS first, 'FeatureCollection' AS kind FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0) GROUP BY 1""",
}
