"""Fuzzy search, similarity scores and matching of two lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import geo, text
from bocage.operators import enrich, matching, proximity
from bocage.session import table


def dice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each establishment's sign to its legal name."""
    df = table(spark, sf_dir, "sirene_etablissements").where("enseigne IS NOT NULL").select("siret", "enseigne", "raison_sociale_unite_legale").distinct()
    score = text.dice(text.compare_key(F.col("enseigne")), text.compare_key(F.col("raison_sociale_unite_legale")))
    return df.select("siret", "enseigne", F.round(score, 6).alias("score"))


def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of part names to a query, alone and as the mean of two fields."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    a = text.trigram_similarity(F.lit("part 12"), F.col("p_name"))
    b = text.trigram_similarity(F.lit("standard"), F.col("p_type"))
    return df.select("p_partkey", F.round(a, 6).alias("name_score"), F.round((a + b) / 2, 6).alias("mean_score"))


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres by name, word similarity."""
    df = table(spark, sf_dir, "centres_sante").select("etab_finess", F.col("etab_raison_sociale").alias("name")).distinct()
    found = matching.search_names(df, "name", "centre de santé dentaire", 0.5, "etab_finess")
    return found.select("etab_finess", F.round("similarity", 6).alias("similarity"))


def name_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidates of each searched name prove about its commune."""
    df = table(spark, sf_dir, "sirene_etablissements").select(
        text.compare_key(F.col("enseigne")).alias("query"), text.compare_key(F.col("raison_sociale_unite_legale")).alias("name"), "siret", F.col("code_commune").alias("commune")
    ).distinct()
    return matching.name_verdict(df.select("query"), df.select("siret", "commune", F.explode(F.array("query", "name")).alias("name")), 0.8)


def people_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practitioners by family and first name."""
    df = table(spark, sf_dir, "annuaire_ameli").select("id", "nom", "prenom").distinct()
    return matching.search_people(df, "bironeau", "josephine", "id").select("id", F.round("similarity", 6).alias("similarity"))


def address_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lines of a centre and of the directory rows at its point."""
    centres = table(spark, sf_dir, "centres_sante").select("etab_finess", "voie", geo.point_lon(F.col("geom")).alias("lon"), geo.point_lat(F.col("geom")).alias("lat")).distinct()
    people = table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'").select("id", "adresse", geo.point_lon(F.col("geom")).alias("lon"), geo.point_lat(F.col("geom")).alias("lat")).distinct()
    verdict, score = matching.address_verdict(F.col("voie"), F.col("adresse"))
    return centres.join(people, ["lon", "lat"]).where("lon <> 0").select("etab_finess", "id", verdict.alias("verdict"), F.round(score, 6).alias("score"))


def reconciliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres against all establishments of their commune."""
    centres = table(spark, sf_dir, "centres_sante").where("code_insee IS NOT NULL").select(
        "etab_finess", "etab_raison_sociale", "voie", F.col("code_insee").alias("c")
    ).distinct().withColumns({"na": text.compare_key(F.col("etab_raison_sociale")), "aa": text.compare_key(F.col("voie"))})
    sites = table(spark, sf_dir, "sirene_etablissements").where("actif").select(
        "siret", "raison_sociale_unite_legale", F.concat_ws(" ", "numero_voie", "type_voie", "libelle_voie").alias("line"), F.col("code_commune").alias("c")
    ).distinct().withColumns({"nb": text.compare_key(F.col("raison_sociale_unite_legale")), "ab": text.compare_key(F.col("line"))})
    left = matching.with_pairs(matching.with_pairs(centres, "na", "pna"), "aa", "paa")
    right = matching.with_pairs(matching.with_pairs(sites, "nb", "pnb"), "ab", "pab")
    # The score is rounded to 3 places, so the bound stays a place below its limit.
    bound = matching.dice_bound("na", "nb", "pna", "pnb") * 0.5 + matching.dice_bound("aa", "ab", "paa", "pab") * 0.4
    near = left.join(right, "c").where(bound >= 0.499).select("etab_finess", "siret", "etab_raison_sociale", "raison_sociale_unite_legale", "voie", "line")
    # Most pairs may be of one commune: what is left to score is dealt out anew.
    near = near.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = matching.reconciled(near, F.col("etab_raison_sociale"), F.col("raison_sociale_unite_legale"), F.col("voie"), F.col("line"))
    return pairs.where("score >= 0.5").select("etab_finess", "siret", "score_name", "score_address", "score", "verdict").distinct()


def _address_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Centres (lkey, la, c) and active establishments (rkey, ra, c), with normalised address and commune."""
    centres = table(spark, sf_dir, "centres_sante").where("code_insee IS NOT NULL AND etab_finess IS NOT NULL").select(
        F.col("etab_finess").alias("lkey"), text.compare_key(F.col("voie")).alias("la"), F.col("code_insee").alias("c")
    ).distinct()
    sites = table(spark, sf_dir, "sirene_etablissements").where("actif AND code_commune IS NOT NULL AND siret IS NOT NULL").select(
        F.col("siret").alias("rkey"), text.compare_key(F.concat_ws(" ", "numero_voie", "type_voie", "libelle_voie")).alias("ra"), F.col("code_commune").alias("c")
    ).distinct()
    return centres, sites


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matching of all centre and establishment addresses of a commune, best first."""
    centres, sites = _address_lists(spark, sf_dir)
    texts = matching.blocked_pairs(centres.select("c", "la").distinct(), sites.select("c", "ra").distinct(), "c", "la", "ra", 0.7)
    group = lambda address: F.concat_ws("|", "c", address)
    edges = texts.select(group("la").alias("a"), group("ra").alias("b"), F.round("score", 6).alias("score"))
    lefts = centres.where("la IS NOT NULL").select(group("la").alias("a"), "lkey")
    return enrich.matched_groups(edges, lefts, sites.select(group("ra").alias("b"), "rkey"), "lkey", "rkey", "score")


def _list_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commune, list, key, matched) of every centre and active establishment."""
    centres, sites = _address_lists(spark, sf_dir)
    found = coverage(spark, sf_dir)
    side = lambda df, key, name: df.select("c", key).distinct().join(found.select(key, F.lit(True).alias("hit")), key, "left").select(
        F.col("c").alias("commune"), F.lit(name).alias("list"), F.col(key).alias("key"), F.coalesce("hit", F.lit(False)).alias("matched")
    )
    return side(centres, "lkey", "centre").unionByName(side(sites, "rkey", "site"))


def coverage_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and establishments that are only in their own list."""
    return _list_members(spark, sf_dir).where("NOT matched").drop("matched")


def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per commune the sizes of both lists, what is matched and only in one, and centres over establishments, null without these."""
    a, b = F.col("list") == "centre", F.col("list") == "site"
    counts = _list_members(spark, sf_dir).groupBy("commune").agg(
        F.count_if(a).alias("n_centres"), F.count_if(b).alias("n_sites"), F.count_if(a & F.col("matched")).alias("n_matched"),
        F.count_if(a & ~F.col("matched")).alias("n_centres_only"), F.count_if(b & ~F.col("matched")).alias("n_sites_only"),
    )
    return counts.withColumn("ratio", F.round(F.try_divide(F.col("n_centres"), F.col("n_sites")), 6))


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory rows on the site of each centre, by distance band."""
    centres = proximity.located(table(spark, sf_dir, "centres_sante"), F.col("etab_finess"))
    people = proximity.located(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'"), F.col("id"))
    near = proximity.near_pairs(centres, people, 100.0)
    band = matching.same_site_band(near, "left_key", "metres")
    return band.select(F.col("left_key").alias("etab_finess"), F.col("right_key").alias("id"), F.round("metres", 3).alias("metres"))


QUERIES = {
    "x03_dice_scores": dice_scores, "x04_trigram_scores": trigram_scores, "c04_name_search": name_search, "c05_name_verdicts": name_verdicts,
    "c09_people_search": people_search, "c28_address_verdicts": address_verdicts, "c29_reconciliations": reconciliations,
    "c32_coverage": coverage, "c32_only": coverage_only, "c32_ratio": coverage_ratio, "c24_site_candidates": site_candidates,
}

from bocage.plans.cleaning import _ABBREVIATION_MAP, _LAT, _LON, sql_compare  # noqa: E402


def sql_dice(a: str, b: str) -> str:
    """Multiset Dice over letter pairs of two normalised expressions."""
    grams = lambda t: f"list_transform(range(1, length({t})), lambda i: substr({t}, i, 2))"
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE
      2.0 * coalesce(list_sum(list_transform(list_distinct({grams(a)}), lambda g: least(len(list_filter({grams(a)}, lambda x: x = g)), len(list_filter({grams(b)}, lambda x: x = g))))), 0)
      / (length({a}) - 1 + length({b}) - 1) END"""


def _sql_trigrams(t: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sql_trigram(a: str, b: str) -> str:
    ta, tb = _sql_trigrams(a), _sql_trigrams(b)
    return f"coalesce(len(list_intersect({ta}, {tb})) * 1.0 / nullif(len(list_distinct(list_concat({ta}, {tb}))), 0), 0.0)"


_SITE_LINE = "concat_ws(' ', numero_voie, type_voie, libelle_voie)"

ORACLE = {
    "x03_dice_scores": f"""WITH n AS (SELECT DISTINCT siret, enseigne, {sql_compare("enseigne")} AS a, {sql_compare("raison_sociale_unite_legale")} AS b FROM sirene_etablissements WHERE enseigne IS NOT NULL),
n2 AS (SELECT DISTINCT siret, enseigne, a, b FROM n)
SELECT siret, enseigne, round({sql_dice("a", "b")}, 6) AS score FROM n2""",
    "x04_trigram_scores": f"""SELECT p_partkey, round({sql_trigram("'part 12'", "p_name")}, 6) AS name_score,
  round(({sql_trigram("'part 12'", "p_name")} + {sql_trigram("'standard'", "p_type")}) / 2, 6) AS mean_score FROM part""",
    "c05_name_verdicts": f"""WITH d AS (SELECT DISTINCT {sql_compare("enseigne")} AS query, {sql_compare("raison_sociale_unite_legale")} AS name, siret, code_commune AS commune FROM sirene_etablissements),
n AS (SELECT DISTINCT siret, commune, name FROM (SELECT siret, commune, unnest([query, name]) AS name FROM d) WHERE name IS NOT NULL),
q AS (SELECT DISTINCT query FROM d WHERE query IS NOT NULL), t AS (SELECT DISTINCT name FROM n),
p AS (SELECT query, name, {sql_dice("query", "name")} AS score FROM q, t WHERE abs(length(query) - length(name)) <= 0.25 * (length(query) + length(name))),
f AS (SELECT DISTINCT query, siret, commune FROM p JOIN n USING (name) WHERE score >= 0.8)
SELECT query, count(*) AS n_candidates, CAST(count(DISTINCT commune) AS INT) AS n_communes, CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT commune) = 1 THEN 'one_commune' ELSE 'several_communes' END AS verdict,
  CASE WHEN count(DISTINCT commune) = 1 THEN min(commune) END AS commune FROM f GROUP BY 1""",
    "c09_people_search": f"""WITH p AS (SELECT DISTINCT id, nom, prenom FROM annuaire_ameli),
s AS (SELECT id, {sql_trigram("'bironeau'", "nom")} AS a, {sql_trigram("'josephine'", "prenom")} AS b FROM p WHERE nom IS NOT NULL AND prenom IS NOT NULL)
SELECT id, round((a + b) / 2, 6) AS similarity FROM s WHERE a >= 0.3 AND b >= 0.3 ORDER BY (a + b) / 2 DESC, id LIMIT 501""",
    "c28_address_verdicts": f"""WITH c AS (SELECT DISTINCT etab_finess, voie, {_LON} AS lon, {_LAT} AS lat FROM centres_sante),
p AS (SELECT DISTINCT id, adresse, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address'),
j AS (SELECT etab_finess, id, voie, adresse, {sql_compare("voie")} AS a, {sql_compare("adresse")} AS b FROM c JOIN p USING (lon, lat) WHERE lon <> 0),
e AS (SELECT *, array_to_string(list_transform(string_split(a, ' '), lambda w: coalesce({_ABBREVIATION_MAP}[w], w)), ' ') AS xa,
  array_to_string(list_transform(string_split(b, ' '), lambda w: coalesce({_ABBREVIATION_MAP}[w], w)), ' ') AS xb FROM j)
SELECT etab_finess, id, CASE WHEN voie IS NULL OR adresse IS NULL THEN 'absent' WHEN a = b THEN 'match' WHEN xa = xb THEN 'match_after_abbreviation' ELSE 'divergent' END AS verdict,
  CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE round({sql_dice("a", "b")}, 6) END AS score FROM e""",
    "c24_site_candidates": f"""WITH c AS (SELECT DISTINCT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante WHERE etab_finess IS NOT NULL AND {_LON} IS NOT NULL AND NOT ({_LON} = 0 AND {_LAT} = 0)),
p AS (SELECT DISTINCT id, {_LON} AS lon, {_LAT} AS lat FROM annuaire_ameli WHERE geom_source = 'ban_address' AND id IS NOT NULL AND {_LON} IS NOT NULL AND NOT ({_LON} = 0 AND {_LAT} = 0)),
d AS (SELECT etab_finess, id, min(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))))) AS m
  FROM c JOIN p ON p.lat BETWEEN c.lat - 0.002 AND c.lat + 0.002 GROUP BY 1, 2 HAVING m <= 100)
SELECT etab_finess, id, round(m, 3) AS metres FROM d QUALIFY m <= min(m) OVER (PARTITION BY etab_finess) + 30""",
    "c29_reconciliations": f"""WITH c AS (SELECT DISTINCT etab_finess, {sql_compare("etab_raison_sociale")} AS na, {sql_compare("voie")} AS aa, code_insee AS c FROM centres_sante WHERE code_insee IS NOT NULL),
s AS (SELECT DISTINCT siret, {sql_compare("raison_sociale_unite_legale")} AS nb, {sql_compare(_SITE_LINE)} AS ab, code_commune AS c FROM sirene_etablissements WHERE actif),
d AS (SELECT etab_finess, siret, {sql_dice("na", "nb")} AS n, {sql_dice("aa", "ab")} AS a FROM c JOIN s USING (c) WHERE na IS NOT NULL AND aa IS NOT NULL)
SELECT DISTINCT etab_finess, siret, round(n, 3) AS score_name, round(a, 3) AS score_address, round(n * 0.5 + a * 0.4, 3) AS score,
  CASE WHEN n * 0.5 + a * 0.4 >= 0.8 THEN 'match' WHEN n * 0.5 + a * 0.4 >= 0.5 THEN 'partial' ELSE 'mismatch' END AS verdict FROM d WHERE round(n * 0.5 + a * 0.4, 3) >= 0.5""",
}
