"""Load gates, work selection, studies of a territory, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.functions import codes
from bocage.functions.numbers import round_half_up
from bocage.operators import quality
from bocage.session import scratch_folder, table
from bocage.streaming import events


def sales_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q5, Q7: the sales table against bands of counts, rates and a median."""
    price = F.when((F.col("prix_m2") > 0) & (F.col("prix_m2") < 1e12), F.col("prix_m2"))
    rules = [
        quality.Rule("rows", F.count("*"), 1000, None),
        quality.Rule("with_price", quality.rate(price.isNotNull()), 0.4, None),
        quality.Rule("without_point", quality.rate(F.coalesce((F.col("longitude") == 0) | F.col("longitude").isNull(), F.lit(True))), None, 0.35, "warning"),
        quality.Rule("bad_commune", quality.rate(~codes.valid(F.col("code_commune"), codes.INSEE)), None, 0.001),
        quality.Rule("communes", F.countDistinct("code_commune"), 500, None),
        quality.Rule("median_price", F.percentile(price, 0.5), 500, 10_000, "warning"),
    ]
    return quality.evaluate(table(spark, sf_dir, "dvf_mutations"), rules)


def directory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4, Q9: rates of the directory: points, addresses, codes."""
    rules = [
        quality.Rule("precise", quality.rate(F.col("geom_source") == "ban_address"), 0.25, None, "warning"),
        quality.Rule("no_point", quality.rate(F.col("geom_source").isNull()), None, 0.1),
        quality.Rule("no_address", quality.rate(F.coalesce(F.trim("adresse") == "", F.lit(True))), None, 0.2),
        quality.Rule("bad_department", quality.rate(~codes.valid_department(F.col("code_departement"))), None, 0.01),
    ]
    return quality.evaluate(table(spark, sf_dir, "annuaire_ameli"), rules)


def geocode_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers still to look up, by attempts so far."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    cache = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 3 != 0).alias("accepted"), (F.col("s_suppkey") % 5).cast("int").alias("attempts")
    )
    return quality.work_selection(keys, cache, "k").groupBy("attempts").agg(F.count("*").alias("n_keys"))


def geocode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows after a round of look-ups."""
    kind = F.element_at(F.array(*map(F.lit, ["housenumber", "street", "municipality"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    results = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 100) / 100.0).alias("score"), kind.alias("kind"),
        (F.col("c_custkey") / 1000.0).alias("lon"), (F.col("c_nationkey") * 1.5).alias("lat"),
    )
    cache = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5).cast("int").alias("attempts"))
    return quality.lookup_results(results, cache, "k", 0.5)


def territory_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a study of each département with their densities, whatever of them there is."""
    people = table(spark, sf_dir, "annuaire_ameli").groupBy("code_departement").agg(F.countDistinct("id").alias("n_people"))
    centres = table(spark, sf_dir, "centres_sante").groupBy("code_departement").agg(F.countDistinct("etab_finess").alias("n_centres"))
    sales = table(spark, sf_dir, "dvf_mutations").groupBy(codes.department_of_insee(F.col("code_commune")).alias("code_departement")).agg(F.count("*").alias("n_sales"))
    towns = table(spark, sf_dir, "communes").groupBy("code_departement").agg(F.sum("population").alias("population"))
    out = towns
    for section in (people, centres, sales):
        out = out.join(section, "code_departement", "left")
    missing = F.filter(
        F.array(F.when(F.col("n_people").isNull(), "people"), F.when(F.col("n_centres").isNull(), "centres"), F.when(F.col("n_sales").isNull(), "sales")),
        lambda x: x.isNotNull(),
    )
    rate = lambda c: F.when(F.col("population") > 0, round_half_up(F.col(c) * 100_000.0 / F.col("population"), 2)).alias(f"{c}_rate")
    return out.select(
        "code_departement", "population", "n_people", "n_centres", "n_sales", rate("n_people"), rate("n_centres"), rate("n_sales"), F.array_join(missing, ",").alias("missing")
    )


def iris_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each commune with the number of geocoded practitioners inside."""
    from bocage.operators import proximity

    people = proximity.located(table(spark, sf_dir, "annuaire_ameli").where("geom_source = 'ban_address'"), F.col("id"))
    areas = table(spark, sf_dir, "iris").where(F.col("code_iris").rlike(codes.IRIS))
    inside = people.join(proximity.containing_regions(people, areas, "code_iris", "geom"), ["lon", "lat"])
    return inside.groupBy(F.col("code").alias("code_iris")).agg(F.countDistinct("key").alias("n_people"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, the batch form of the streaming query."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows as a stream over the event files, run until nothing is left."""
    stream = events.event_stream(spark, sf_dir, pattern="events.parquet")
    out = events.run_available(events.windowed_counts(stream, "1 day"), scratch_folder(spark, "windows"), "update", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def streamed_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, as a stream that forgets keys beyond its watermark, then counted by type."""
    stream = events.event_stream(spark, sf_dir, pattern="events.parquet")
    out = events.run_available(events.once(stream, delay="400 days"), scratch_folder(spark, "unique"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with a gap of six hours, as a stream: how many there are of each length."""
    stream = events.event_stream(spark, sf_dir, pattern="events.parquet")
    out = events.run_available(events.sessions(stream, "6 hours"), scratch_folder(spark, "sessions"), "complete")
    return out.groupBy(F.col("n").alias("n_events")).agg(F.count("*").alias("n_sessions"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of the JSON of each event, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by region and year: a star of five tables with pre-aggregated lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "year").agg(F.count("*").alias("n_orders"), F.round(F.sum("revenue"), 0).alias("revenue"))


QUERIES = {
    "q07_sales_gate": sales_gate, "q09_directory_gate": directory_gate, "q13_geocode_work": geocode_work, "q14_geocode_results": geocode_results,
    "c34_territory_panorama": territory_panorama, "c13_iris_profiles": iris_profiles, "s_event_windows": event_windows, "s_streamed_windows": streamed_windows,
    "s_streamed_unique": streamed_unique, "s_streamed_sessions": streamed_sessions,
    "n02_event_properties": event_properties, "a00_order_revenue": order_revenue,
}

from bocage.plans.problems import _SQL_INSIDE  # noqa: E402

_PRICE = "CASE WHEN isfinite(prix_m2) AND prix_m2 > 0 AND prix_m2 < 1e12 THEN prix_m2 END"


def _rule(name: str, severity: str, value: str, low, high) -> str:
    band = " AND ".join([*([f"v >= {low}"] if low is not None else []), *([f"v <= {high}"] if high is not None else [])])
    number = lambda x: "NULL" if x is None else f"{x}"
    return f"SELECT '{name}' AS rule, '{severity}' AS severity, v AS value, CAST({number(low)} AS DOUBLE) AS low, CAST({number(high)} AS DOUBLE) AS high, {band} AS ok FROM (SELECT round(CAST({value} AS DOUBLE), 6) AS v FROM t)"


ORACLE = {
    "q07_sales_gate": "WITH t AS (SELECT * FROM dvf_mutations) "
    + " UNION ALL ".join(
        [
            _rule("rows", "fatal", "count(*)", 1000, None),
            _rule("with_price", "fatal", f"count({_PRICE}) / count(*)", 0.4, None),
            _rule("without_point", "warning", "count_if(coalesce(longitude, 0) = 0) / count(*)", None, 0.35),
            _rule("bad_commune", "fatal", "count_if(NOT coalesce(regexp_full_match(code_commune, '[0-9][0-9AB][0-9]{3}'), false)) / count(*)", None, 0.001),
            _rule("communes", "fatal", "count(DISTINCT code_commune)", 500, None),
            _rule("median_price", "warning", f"quantile_cont({_PRICE}, 0.5)", 500, 10000),
        ]
    ),
    "q09_directory_gate": "WITH t AS (SELECT * FROM annuaire_ameli) "
    + " UNION ALL ".join(
        [
            _rule("precise", "warning", "count_if(geom_source = 'ban_address') / count(*)", 0.25, None),
            _rule("no_point", "fatal", "count_if(geom_source IS NULL) / count(*)", None, 0.1),
            _rule("no_address", "fatal", "count_if(coalesce(trim(adresse) = '', true)) / count(*)", None, 0.2),
            _rule("bad_department", "fatal", r"count_if(NOT coalesce(regexp_full_match(code_departement, '\d{2}|2A|2B|97[1-8]|98[4-8]') AND code_departement <> '20', false)) / count(*)", None, 0.01),
        ]
    ),
    "q13_geocode_work": """SELECT coalesce(s.s_suppkey % 5, 0) AS attempts, count(*) AS n_keys FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey
WHERE s.s_suppkey IS NULL OR (s.s_suppkey % 3 = 0 AND s.s_suppkey % 5 < 3) GROUP BY 1""",
    "q14_geocode_results": """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 100) / 100.0 END AS score, ['housenumber', 'street', 'municipality'][c_custkey % 3 + 1] AS kind,
  c_custkey / 1000.0 AS lon, c_nationkey * 1.5 AS lat FROM customer), g AS (SELECT *, coalesce(score >= 0.5 AND kind <> 'municipality', false) AS good FROM r)
SELECT k, good AS accepted, CAST(CASE WHEN good THEN lon END AS DOUBLE) AS lon, CAST(CASE WHEN good THEN lat END AS DOUBLE) AS lat, CAST(coalesce(s_suppkey % 5, 0) + 1 AS INT) AS attempts,
  CASE WHEN good THEN 'accepted' WHEN score IS NULL THEN 'unresolved' ELSE 'rejected_low_score' END AS last_status FROM g LEFT JOIN supplier ON s_suppkey = k""",
    "c34_territory_panorama": """WITH p AS (SELECT code_departement, count(DISTINCT id) AS n_people FROM annuaire_ameli GROUP BY 1), c AS (SELECT code_departement, count(DISTINCT etab_finess) AS n_centres FROM centres_sante GROUP BY 1),
s AS (SELECT CASE WHEN code_commune[1:2] IN ('97', '98') THEN CASE WHEN length(code_commune) >= 3 THEN code_commune[1:3] END WHEN length(code_commune) >= 2 THEN code_commune[1:2] END AS code_departement, count(*) AS n_sales FROM dvf_mutations GROUP BY 1),
t AS (SELECT code_departement, CAST(sum(population) AS BIGINT) AS population FROM communes GROUP BY 1)
SELECT code_departement, population, n_people, n_centres, n_sales, floor(n_people * 100000.0 / population * 100 + 0.5) / 100 AS n_people_rate,
  floor(n_centres * 100000.0 / population * 100 + 0.5) / 100 AS n_centres_rate, floor(n_sales * 100000.0 / population * 100 + 0.5) / 100 AS n_sales_rate,
  concat_ws(',', CASE WHEN n_people IS NULL THEN 'people' END, CASE WHEN n_centres IS NULL THEN 'centres' END, CASE WHEN n_sales IS NULL THEN 'sales' END) AS missing
FROM t LEFT JOIN p USING (code_departement) LEFT JOIN c USING (code_departement) LEFT JOIN s USING (code_departement)""",
    "c13_iris_profiles": "WITH "
    + _SQL_INSIDE.lstrip().replace(
        """SELECT DISTINCT etab_finess, """, """SELECT DISTINCT id AS etab_finess, """
    ).replace("FROM centres_sante\n  WHERE etab_finess IS NOT NULL", "FROM annuaire_ameli\n  WHERE geom_source = 'ban_address' AND id IS NOT NULL")
    + " SELECT code_iris, count(DISTINCT etab_finess) AS n_people FROM inside GROUP BY 1",
    "s_event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "s_streamed_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "s_streamed_unique": "SELECT event_type, count(DISTINCT event_id) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1",
    "s_streamed_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), c AS (SELECT user_id, no, count(*) AS n_events FROM s GROUP BY 1, 2)
SELECT n_events, count(*) AS n_sessions FROM c GROUP BY 1""",
    "n02_event_properties": """SELECT event_type, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
    "a00_order_revenue": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1)
SELECT r_name, year(o_orderdate) AS year, count(*) AS n_orders, round(sum(revenue), 0) AS revenue FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
}
