"""Queries of the general problems 2, 5 and 6, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.operators import proximity, rejects, snapshots
from bocage.session import table

NEAR_M = 150.0
AMELI_TEXT = ("nom", "prenom", "specialite_code", "code_postal", "telephone", "secteur_conventionnel_code")
IRIS_CODE = r"^(?:[0-9]{2}|2A|2B)[0-9]{7}$"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "ameli_raw"))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.strict_load(table(spark, sf_dir, "ameli_raw"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load report: records by outcome."""
    records = table(spark, sf_dir, "ameli_raw")
    bad = rejects.rejected(records).groupBy("reason").agg(F.count("*").alias("n_records"))
    good = rejects.strict_load(records).agg(F.lit("loaded").alias("reason"), F.count("*").alias("n_records"))
    return bad.unionByName(good)


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.located(table(spark, sf_dir, "centres_sante"), F.col("etab_finess"))


def _iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "iris").where(F.col("code_iris").rlike(IRIS_CODE))


def p5_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(etab_finess, code_iris) by crossing parity."""
    centres = _centres(spark, sf_dir)
    inside = proximity.containing_regions(centres, _iris(spark, sf_dir), "code_iris", "geom")
    return centres.join(inside, ["lon", "lat"]).select(
        F.col("key").alias("etab_finess"), F.col("code").alias("code_iris")
    ).distinct()


def p5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(etab_finess, id, metres) of directory rows geocoded to the address within 150 m."""
    people = table(spark, sf_dir, "annuaire_ameli").where(F.col("geom_source") == "ban_address")
    pairs = proximity.near_pairs(_centres(spark, sf_dir), proximity.located(people, F.col("id")), NEAR_M)
    return pairs.select(
        F.col("left_key").alias("etab_finess"), F.col("right_key").alias("id"), F.round("metres", 3).alias("metres")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = p5_containing(spark, sf_dir).select(
        F.lit("iris").alias("relation"), "etab_finess", F.col("code_iris").alias("autre_cle")
    )
    near = p5_near(spark, sf_dir).select(
        F.lit("proche").alias("relation"), "etab_finess", F.col("id").cast("string").alias("autre_cle")
    )
    return inside.unionByName(near)


def _ameli_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "ameli_snapshots")
    values = [snapshots.careless_text(F.col(c)) for c in AMELI_TEXT]
    return snapshots.snapshot_changes(df, "snapshot_no", "id", values, order="loaded_at")


def _freshness_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "data_freshness")
    return snapshots.snapshot_changes(
        df, "snapshot_no", "source", [F.col("last_data_change_at")], order="last_attempt_at"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["dataset", "record_key", "snapshot_no", "change_kind"]
    ameli = _ameli_changes(spark, sf_dir).withColumn("dataset", F.lit("ameli")).select(columns)
    freshness = _freshness_changes(spark, sf_dir).withColumn("dataset", F.lit("freshness")).select(columns)
    return ameli.unionByName(freshness)


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory changes with the row before and after, as JSON."""
    changes = _ameli_changes(spark, sf_dir)
    df = table(spark, sf_dir, "ameli_snapshots")
    return snapshots.change_values(df, changes, "snapshot_no", "id", AMELI_TEXT, order="loaded_at")


QUERIES = {
    "p2_found": p2_found, "p2_loaded": p2_loaded, "p2_reasons": p2_reasons,
    "p5_found": p5_found, "p5_containing": p5_containing, "p5_near": p5_near,
    "p6_found": p6_found, "p6_values": p6_values,
}

_SQL_RAW = r"""
WITH body AS (
  SELECT raw_id, regexp_replace(coalesce(raw, ''), '(\r\n|\n|\r)$', '') AS body FROM ameli_raw
), split AS (
  SELECT raw_id,
    CASE WHEN regexp_full_match(body, '(?s)("([^"]|"")*"|[^";]*)(;("([^"]|"")*"|[^";]*))*') THEN
      list_transform(
        regexp_extract_all(';' || body, '(?s);("(?:[^"]|"")*"|[^";]*)', 1),
        lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:len(x)-1], '""', '"') ELSE x END)
    END AS v
  FROM body
), named AS (
  SELECT raw_id, v, list_transform(v, lambda x: regexp_replace(x, '^[\s\x{00A0}\x{202F}]+|[\s\x{00A0}\x{202F}]+$', '', 'g')) AS t
  FROM split
), judged AS (
  SELECT raw_id, v, t, CASE
    WHEN v IS NULL THEN 'quoting'
    WHEN len(v) <> 15 THEN 'column_count'
    WHEN NOT regexp_full_match(t[1], '[0-9]+') THEN 'id_ligne'
    WHEN t[9] <> '' AND NOT regexp_full_match(t[9], '[0-9]{5}') THEN 'code_postal'
    WHEN t[11] <> '' AND NOT regexp_full_match(t[11], '(0[1-9]|[1-8][0-9]|9[0-5]|97|98|2A|2B)[0-9]{3}') THEN 'code_insee'
    WHEN t[13] <> '' AND (NOT regexp_full_match(t[13], '(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}')
         OR try_cast(t[13] AS DATE) IS NULL) THEN 'date_maj'
    WHEN t[14] <> '' AND (NOT regexp_full_match(t[14], '[-+]?[0-9]+([.][0-9]+)?')
         OR abs(try_cast(t[14] AS DOUBLE)) > 180) THEN 'coordonnee'
    WHEN t[15] <> '' AND (NOT regexp_full_match(t[15], '[-+]?[0-9]+([.][0-9]+)?')
         OR abs(try_cast(t[15] AS DOUBLE)) > 90) THEN 'coordonnee'
  END AS reason
  FROM named
)
"""

def _sql_point(which: int, geom: str = "geom") -> str:
    return f"try_cast(regexp_extract({geom}, '(?i)POINT *[(] *([-+0-9.]+) +([-+0-9.]+) *[)]', {which}) AS DOUBLE)"


_SQL_CENTRES = f"""
centres AS (
  SELECT DISTINCT etab_finess, {_sql_point(1)} AS lon, {_sql_point(2)} AS lat FROM centres_sante
  WHERE etab_finess IS NOT NULL AND {_sql_point(1)} IS NOT NULL AND NOT ({_sql_point(1)} = 0 AND {_sql_point(2)} = 0)
)"""

_SQL_INSIDE = f"""
{_SQL_CENTRES}, shapes AS (
  SELECT DISTINCT code_iris, geom FROM iris WHERE regexp_full_match(code_iris, '([0-9]{{2}}|2A|2B)[0-9]{{7}}')
), rings AS (
  SELECT code_iris, hash(geom) AS shape, unnest(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) AS ring FROM shapes
), pts AS (
  SELECT code_iris, shape, list_transform(string_split(ring, ','), lambda p: [
    CAST(string_split(trim(p), ' ')[1] AS DOUBLE), CAST(string_split(trim(p), ' ')[-1] AS DOUBLE)]) AS p FROM rings
), edges AS (
  SELECT code_iris, shape, p[i][1] AS x1, p[i][2] AS y1, p[i % len(p) + 1][1] AS x2, p[i % len(p) + 1][2] AS y2
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pts)
), inside AS (
  SELECT etab_finess, code_iris FROM centres JOIN edges ON lat BETWEEN least(y1, y2) AND greatest(y1, y2)
  GROUP BY etab_finess, lon, lat, code_iris, shape
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) <= 1e-12
               AND lon BETWEEN least(x1, x2) AND greatest(x1, x2))
)"""

_SQL_NEAR = f"""
{_SQL_CENTRES}, people AS (
  SELECT DISTINCT id, {_sql_point(1)} AS lon, {_sql_point(2)} AS lat FROM annuaire_ameli
  WHERE geom_source = 'ban_address' AND id IS NOT NULL AND {_sql_point(1)} IS NOT NULL
    AND NOT ({_sql_point(1)} = 0 AND {_sql_point(2)} = 0)
), near AS (
  SELECT etab_finess, id, min(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2)
    + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))))) AS metres
  FROM centres c JOIN people p ON p.lat BETWEEN c.lat - 0.002 AND c.lat + 0.002
  GROUP BY etab_finess, id HAVING metres <= 150
)"""

_SQL_CARELESS = ", ".join(
    rf"lower(trim(regexp_replace(coalesce({c}, ''), '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))) AS {c}"
    for c in AMELI_TEXT
)

_SQL_CHANGES = f"""
WITH held AS (
  SELECT 'ameli' AS dataset, CAST(id AS VARCHAR) AS record_key, snapshot_no,
    [{", ".join(AMELI_TEXT)}] AS v
  FROM (SELECT id, snapshot_no, loaded_at, {_SQL_CARELESS} FROM ameli_snapshots WHERE id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY id, snapshot_no ORDER BY loaded_at DESC NULLS LAST) = 1
  UNION ALL
  SELECT 'freshness', source, snapshot_no, [CAST(last_data_change_at AS VARCHAR)] FROM data_freshness
  WHERE source IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, snapshot_no ORDER BY last_attempt_at DESC NULLS LAST) = 1
), steps AS (
  SELECT dataset, n AS snapshot_no, lag(n) OVER (PARTITION BY dataset ORDER BY n) AS previous_no
  FROM (SELECT DISTINCT dataset, snapshot_no AS n FROM held)
), pairs AS (
  SELECT s.dataset, s.snapshot_no, s.previous_no, h.record_key, h.v AS after, NULL AS before
  FROM steps s JOIN held h ON h.dataset = s.dataset AND h.snapshot_no = s.snapshot_no
  WHERE s.previous_no IS NOT NULL
)
SELECT a.dataset, a.record_key, a.snapshot_no, CASE WHEN b.record_key IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs a LEFT JOIN held b ON b.dataset = a.dataset AND b.snapshot_no = a.previous_no AND b.record_key = a.record_key
WHERE b.record_key IS NULL OR a.after IS DISTINCT FROM b.v
UNION ALL
SELECT s.dataset, b.record_key, s.snapshot_no, 'removed'
FROM steps s JOIN held b ON b.dataset = s.dataset AND b.snapshot_no = s.previous_no
ANTI JOIN held a ON a.dataset = s.dataset AND a.snapshot_no = s.snapshot_no AND a.record_key = b.record_key
"""

ORACLE = {
    "p2_found": _SQL_RAW + "SELECT DISTINCT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": _SQL_RAW
    + "SELECT raw_id, CAST(t[1] AS DECIMAL(38,0)) AS id_ligne, "
    + ", ".join(
        f"nullif(t[{i}], '') AS {name}"
        for i, name in enumerate(rejects.FIELDS, 1)
        if name not in ("id_ligne", "date_maj", "longitude", "latitude")
    )
    + ", try_cast(t[13] AS DATE) AS date_maj, try_cast(t[14] AS DOUBLE) AS longitude, "
    "try_cast(t[15] AS DOUBLE) AS latitude FROM judged WHERE reason IS NULL",
    "p2_reasons": _SQL_RAW
    + "SELECT coalesce(reason, 'loaded') AS reason, count(*) AS n_records FROM judged GROUP BY 1",
    "p5_found": f"WITH {_SQL_INSIDE}, {_SQL_NEAR.replace(_SQL_CENTRES + ', ', '')} "
    "SELECT DISTINCT 'iris' AS relation, etab_finess, code_iris AS autre_cle FROM inside "
    "UNION ALL SELECT 'proche', etab_finess, CAST(id AS VARCHAR) FROM near",
    "p5_containing": f"WITH {_SQL_INSIDE} SELECT DISTINCT etab_finess, code_iris FROM inside",
    "p5_near": f"WITH {_SQL_NEAR} SELECT etab_finess, id, round(metres, 3) AS metres FROM near",
    "p6_found": _SQL_CHANGES,
}
