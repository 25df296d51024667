"""Projections and scalar functions over the registry tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import codes, geo, numbers, text
from bocage.session import table


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with control characters and blank runs cleaned, blank as null."""
    df = table(spark, sf_dir, "annuaire_ameli")
    return df.select("id", text.clean_text(F.col("raison_sociale")).alias("name"), text.non_empty(F.col("adresse")).alias("address")).distinct()


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and loose numbers, coordinates and booleans out of raw text."""
    raw = F.split("raw", ";")
    last, before = F.element_at(raw, -1), F.try_element_at(raw, F.lit(-2))
    return table(spark, sf_dir, "ameli_raw").select(
        "raw_id", numbers.strict_number(last).alias("strict"), numbers.loose_number(last).alias("loose"),
        numbers.loose_coordinate(before).alias("coordinate"), numbers.strict_boolean(F.lower(last)).alias("flag"),
        numbers.boolean_fallback(last).alias("guessed"),
    )


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First phone number without separators."""
    df = table(spark, sf_dir, "annuaire_ameli")
    return df.select("id", text.first_phone(F.col("telephone")).alias("phone")).where("phone IS NOT NULL").distinct()


def derived_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per square metre of dwellings with a built surface; other surfaces are null."""
    df = table(spark, sf_dir, "dvf_mutations")
    built = F.when(F.col("surface_reelle_bati") > 0, F.col("surface_reelle_bati"))
    price = F.when(F.col("type_local").isin("Maison", "Appartement"), F.try_divide("valeur_fonciere", built))
    land = F.when(F.col("surface_terrain") > 0, F.col("surface_terrain"))
    kept = df.select("id_mutation", "type_local", F.round(price, 4).alias("price_m2"), land.alias("land"))
    return kept.where(F.col("price_m2").isNotNull() | F.col("land").isNotNull()).groupBy("type_local").agg(
        F.count("*").alias("n_rows"), F.count("price_m2").alias("n_prices"), F.count("land").alias("n_lands")
    )


def precision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public precision of a point by where it came from; unknown provenance is null."""
    labels = {"ban_address": "adresse", "finess_join": "etablissement_finess", "commune_centroid": "centroide_commune"}
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    df = table(spark, sf_dir, "annuaire_ameli").withColumn("precision", F.try_element_at(known, F.col("geom_source")))
    return df.groupBy("geom_source", "precision").agg(F.count("*").alias("n_rows"))


def rounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres, clamping, rounding half up below zero, compact count labels."""
    df = table(spark, sf_dir, "lineitem")
    signed = F.col("l_quantity") - 25.5
    n = (F.col("l_orderkey") * F.col("l_partkey")).cast("long")
    return df.select(
        "l_orderkey", "l_linenumber", numbers.km(F.col("l_extendedprice")).alias("km"), numbers.clamp(F.col("l_quantity"), 5, 40).alias("clamped"),
        numbers.round_half_up(signed / 8, 2).alias("half_up"), numbers.count_label(n).alias("label"),
    )


def comparable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names folded for comparison."""
    df = table(spark, sf_dir, "sirene_etablissements")
    return df.select("siret", text.compare_key(F.coalesce("enseigne", "raison_sociale_unite_legale")).alias("name_key")).distinct()


def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocode-cache keys of addresses."""
    df = table(spark, sf_dir, "annuaire_ameli")
    return df.select("id", text.address_key(F.col("adresse"), F.col("code_postal"), F.col("code_insee")).alias("address_key")).distinct()


def commune_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commune names in capitals and leading postal codes."""
    df = table(spark, sf_dir, "centres_sante")
    return df.select("etab_finess", text.commune_name(F.col("ville")).alias("town"), codes.postal_prefix(F.col("code_postal")).alias("postal")).distinct()


def street_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder lines and addresses with abbreviations in full."""
    df = table(spark, sf_dir, "annuaire_ameli").where("adresse IS NOT NULL")
    plain = text.compare_key(F.col("adresse"))
    return df.select(
        "id", text.geocoder_line(F.col("adresse")).alias("line"), text.expand_abbreviations(plain).alias("expanded")
    ).distinct()


def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code validity, départements, SIREN, activity and parent commune."""
    df = table(spark, sf_dir, "sirene_etablissements")
    return df.select(
        "siret", codes.valid(F.col("siret"), codes.SIRET).alias("ok_siret"), codes.valid(F.col("code_commune"), codes.INSEE).alias("ok_commune"),
        codes.siren_of_siret(F.col("siret")).alias("siren_part"), codes.naf_key(F.col("naf")).alias("naf_key"),
        codes.department_of_insee(F.col("code_commune")).alias("dep_insee"), codes.department_of_postal(F.col("code_postal")).alias("dep_postal"),
        codes.parent_commune(F.col("code_commune")).alias("parent"),
    ).distinct()


def month_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict dates, month keys, lags and ages."""
    df = table(spark, sf_dir, "dvf_mutations")
    day, now = F.col("date_mutation"), F.lit("2027-01-01").cast("date")
    read = numbers.strict_date(F.date_format(day, "yyyy-MM-dd"))
    return df.groupBy(numbers.month_key(day).alias("month"), numbers.month_number(day).alias("month_no")).agg(
        F.count(read).alias("n_dates"), F.max(numbers.month_lag(now, day)).alias("lag"),
        F.max(numbers.age_days(now.cast("timestamp_ntz"), F.col("loaded_at"))).alias("oldest_days"), F.max(F.datediff(now, day)).alias("oldest_sale"),
    )


def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as GeoJSON features."""
    df = table(spark, sf_dir, "centres_sante")
    point = df.select("etab_finess", geo.point_lon(F.col("geom")).alias("lon"), geo.point_lat(F.col("geom")).alias("lat")).distinct()
    # Micro-degrees without exponents or trailing zeros, so that every reader sees the same text.
    plain = lambda c: F.regexp_replace(F.col(c).cast("decimal(9,6)").cast("string"), r"\.?0+$", "")
    body = F.concat(F.lit('{"type":"Point","coordinates":['), plain("lon"), F.lit(","), plain("lat"), F.lit("]}"))
    return point.where(geo.usable_point(F.col("lon"), F.col("lat"))).select("etab_finess", body.alias("geojson"))


def ring_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: mean of the vertices of a polygon's rings, which is not its centre of area."""
    rings = table(spark, sf_dir, "iris").where("code_iris IS NOT NULL").select("code_iris", geo.polygon_rings(F.col("geom")).alias("rings")).distinct()
    # Sums in whole micro-degrees, so the mean does not depend on the order of the rows.
    mean = lambda c: F.floor(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count("*") + 0.5) / 1e6
    vertices = rings.select("code_iris", F.explode(F.flatten("rings")).alias("p"))
    return vertices.groupBy("code_iris").agg(F.count("*").alias("n_vertices"), mean("p.x").alias("lon"), mean("p.y").alias("lat"))


QUERIES = {
    "proj01_clean_names": clean_names, "proj03_typed_values": typed_values, "proj12_phones": phones, "proj13_derived_prices": derived_prices,
    "proj15_precision_labels": precision_labels, "proj16_rounded_numbers": rounded_numbers, "x02_comparable_names": comparable_names,
    "x07_address_keys": address_keys, "x09_commune_names": commune_names, "x11_street_lines": street_lines, "x14_code_parts": code_parts,
    "d01_month_parts": month_parts, "n01_geojson_points": geojson_points, "m03_ring_centres": ring_centres,
}

def sql_fold(value: str) -> str:
    return f"strip_accents(replace(replace(replace(lower({value}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'))"


def sql_compare(value: str) -> str:
    return f"trim(regexp_replace({sql_fold(value)}, '[.,''’\\-\\s]+', ' ', 'g'))"


def sql_key_field(value: str) -> str:
    spaces = "[\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
    inner = f"regexp_replace(coalesce({value}, ''), '{spaces}', ' ', 'g')"
    inner = f"regexp_replace({inner}, '\\bCEDEX[ \\t\\n\\x0B\\f\\r]*\\d*', ' ', 'gi')"
    return f"upper(trim(regexp_replace({inner}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


_ABBREVIATION_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STREET_ABBREVIATIONS.items()) + "}"
_LINE = "CASE WHEN strpos(adresse, ',') > 0 AND regexp_matches(adresse, '^\\s*\\d') THEN split_part(adresse, ',', 1) ELSE adresse END"
_ZEROS = f"regexp_replace(regexp_replace({_LINE}, '^(\\s*)0*(\\d+)(\\s|$)', '\\1\\2\\3'), '^(\\s*)0(\\s|$)', '\\1')"
_PARENT = "CASE " + " ".join(f"WHEN code_commune BETWEEN '{a}' AND '{b}' THEN '{p}'" for p, a, b in codes.DISTRICTS) + " ELSE code_commune END"
_LON = "try_cast(regexp_extract(geom, '(?i)POINT *[(] *([-+0-9.]+) +([-+0-9.]+) *[)]', 1) AS DOUBLE)"
_LAT = "try_cast(regexp_extract(geom, '(?i)POINT *[(] *([-+0-9.]+) +([-+0-9.]+) *[)]', 2) AS DOUBLE)"

ORACLE = {
    "proj01_clean_names": r"""SELECT DISTINCT id, nullif(trim(regexp_replace(regexp_replace(raison_sociale, '[\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g')), '') AS name,
  nullif(trim(adresse), '') AS address FROM annuaire_ameli""",
    "proj03_typed_values": r"""WITH v AS (SELECT raw_id, string_split(raw, ';')[-1] AS l, string_split(raw, ';')[-2] AS b FROM ameli_raw)
SELECT raw_id, CASE WHEN regexp_full_match(trim(l), '-?\d+(\.\d+)?') THEN try_cast(trim(l) AS DOUBLE) END AS strict,
  CASE WHEN NOT isnan(try_cast(regexp_replace(replace(l, ',', '.'), '^\s+|\s+$', '', 'g') AS DOUBLE)) THEN try_cast(regexp_replace(replace(l, ',', '.'), '^\s+|\s+$', '', 'g') AS DOUBLE) END AS loose,
  try_cast(nullif(regexp_extract(regexp_replace(b, '^([^,]*),', '\1.'), '^\s*([-+]?(\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE) AS coordinate,
  lower(trim(l)) = 'true' AS flag, lower(trim(l)) NOT IN ('true', 'false') AS guessed FROM v""",
    "proj12_phones": r"""SELECT DISTINCT id, nullif(trim(regexp_replace(regexp_split_to_array(telephone, '[/;,]')[1], '[\s.\-()]', '', 'g')), '') AS phone
FROM annuaire_ameli WHERE phone IS NOT NULL""",
    "proj13_derived_prices": """SELECT type_local, count(*) AS n_rows, count(price_m2) AS n_prices, count(land) AS n_lands FROM (
  SELECT type_local, CASE WHEN type_local IN ('Maison', 'Appartement') AND surface_reelle_bati > 0 THEN valeur_fonciere / surface_reelle_bati END AS price_m2,
    CASE WHEN surface_terrain > 0 THEN surface_terrain END AS land FROM dvf_mutations)
WHERE price_m2 IS NOT NULL OR land IS NOT NULL GROUP BY type_local""",
    "proj15_precision_labels": """SELECT geom_source, CASE geom_source WHEN 'ban_address' THEN 'adresse' WHEN 'finess_join' THEN 'etablissement_finess'
  WHEN 'commune_centroid' THEN 'centroide_commune' END AS precision, count(*) AS n_rows FROM annuaire_ameli GROUP BY ALL""",
    "proj16_rounded_numbers": """WITH v AS (SELECT *, l_orderkey * l_partkey AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 1000.0 * 100 + 0.5) / 100 AS km, greatest(5.0, least(40.0, l_quantity)) AS clamped,
  floor((l_quantity - 25.5) / 8 * 100 + 0.5) / 100 AS half_up,
  CASE WHEN n >= 10000000 THEN CAST(floor(n / 1000000) AS BIGINT) || 'M' WHEN n >= 1000000 THEN format('{:.1f}', round(n / 1000000.0, 1)) || 'M'
    WHEN n >= 10000 THEN CAST(floor(n / 1000) AS BIGINT) || 'K' WHEN n >= 1000 THEN format('{:.1f}', round(n / 1000.0, 1)) || 'K' ELSE CAST(n AS VARCHAR) END AS label FROM v""",
    "x02_comparable_names": f"SELECT DISTINCT siret, {sql_compare('coalesce(enseigne, raison_sociale_unite_legale)')} AS name_key FROM sirene_etablissements",
    "x07_address_keys": f"SELECT DISTINCT id, {sql_key_field('adresse')} || '|' || {sql_key_field('code_postal')} || '|' || {sql_key_field('code_insee')} AS address_key FROM annuaire_ameli",
    "x09_commune_names": rf"""SELECT DISTINCT etab_finess, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper({sql_fold("ville")}), '[-''’,.]', ' ', 'g'), '\s+', ' ', 'g')),
  '\bSTE\b', 'SAINTE', 'g'), '\bST\b', 'SAINT', 'g') AS town, nullif(regexp_extract(code_postal, '^\s*(\d{{5}})', 1), '') AS postal FROM centres_sante""",
    "x11_street_lines": f"""SELECT DISTINCT id, CASE WHEN regexp_matches({_ZEROS}, '[A-Za-z]') THEN {_ZEROS} ELSE adresse END AS line,
  array_to_string(list_transform(string_split({sql_compare("adresse")}, ' '), lambda w: coalesce({_ABBREVIATION_MAP}[w], w)), ' ') AS expanded
FROM annuaire_ameli WHERE adresse IS NOT NULL""",
    "x14_code_parts": rf"""SELECT DISTINCT siret, coalesce(regexp_full_match(siret, '\d{{14}}'), false) AS ok_siret,
  coalesce(regexp_full_match(code_commune, '[0-9][0-9AB][0-9]{{3}}'), false) AS ok_commune, siret[1:9] AS siren_part, upper(replace(trim(naf), '.', '')) AS naf_key,
  CASE WHEN code_commune[1:2] IN ('97', '98') THEN CASE WHEN length(code_commune) >= 3 THEN code_commune[1:3] END WHEN length(code_commune) >= 2 THEN code_commune[1:2] END AS dep_insee,
  CASE WHEN regexp_matches(trim(code_postal), '^\d{{5}}') AND code_postal[1:2] <> '20'
    AND regexp_full_match(CASE WHEN code_postal[1:2] IN ('97', '98') THEN trim(code_postal)[1:3] ELSE trim(code_postal)[1:2] END, '(0[1-9]|1\d|2[1-9]|[3-8]\d|9[0-5]|97[1-8]|98[4-8])')
    THEN CASE WHEN code_postal[1:2] IN ('97', '98') THEN trim(code_postal)[1:3] ELSE trim(code_postal)[1:2] END END AS dep_postal,
  {_PARENT} AS parent FROM sirene_etablissements""",
    "d01_month_parts": """SELECT strftime(date_mutation, '%Y-%m') AS month, year(date_mutation) * 100 + month(date_mutation) AS month_no, count(date_mutation) AS n_dates,
  max((2027 - year(date_mutation)) * 12 + 1 - month(date_mutation)) AS lag,
  max(CAST(floor(floor(epoch(TIMESTAMP '2027-01-01') - floor(epoch(loaded_at))) / 86400) AS INT)) AS oldest_days,
  max(date_diff('day', date_mutation, DATE '2027-01-01')) AS oldest_sale FROM dvf_mutations GROUP BY ALL""",
    "n01_geojson_points": f"""WITH p AS (SELECT DISTINCT etab_finess, {_LON} AS lon, {_LAT} AS lat FROM centres_sante)
SELECT etab_finess, '{{"type":"Point","coordinates":[' || regexp_replace(CAST(CAST(lon AS DECIMAL(9,6)) AS VARCHAR), '\\.?0+$', '') || ',' || regexp_replace(CAST(CAST(lat AS DECIMAL(9,6)) AS VARCHAR), '\\.?0+$', '') || ']}}' AS geojson FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0)""",
    "m03_ring_centres": r"""WITH shapes AS (SELECT DISTINCT code_iris, geom FROM iris WHERE code_iris IS NOT NULL),
rings AS (SELECT code_iris, unnest(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) AS r FROM shapes),
pts AS (SELECT code_iris, unnest(string_split(r, ',')) AS p FROM rings)
SELECT code_iris, count(*) AS n_vertices, floor(sum(CAST(round(CAST(regexp_split_to_array(trim(p), '\s+')[1] AS DOUBLE) * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lon,
  floor(sum(CAST(round(CAST(regexp_split_to_array(trim(p), '\s+')[2] AS DOUBLE) * 1e6) AS BIGINT)) / count(*) + 0.5) / 1e6 AS lat FROM pts GROUP BY code_iris""",
}
