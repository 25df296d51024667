"""Queries of the training-data problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.llm import encoding, linkage, mixing, packing, percentiles, places, tokens, variants
from bocage.session import checkpoint, table


def _centre_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = linkage.latest(table(spark, sf_dir, "centres_sante"), "etab_finess", "created_at")
    return linkage.prepare(
        centres, table(spark, sf_dir, "communes"), "centre", "etab_finess", [F.col("etab_raison_sociale")],
        [F.col("voie"), F.col("complement_voie"), F.col("lieu_dit")], F.col("code_insee"), F.col("code_postal"), F.col("ville"),
    )


def _establishment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = linkage.latest(table(spark, sf_dir, "sirene_etablissements"), "siret", "date_maj").where(F.col("actif"))
    return linkage.prepare(
        sites, table(spark, sf_dir, "communes"), "site", "siret",
        [F.col("raison_sociale_unite_legale"), F.col("enseigne"), F.col("denomination_usuelle")],
        [F.col("numero_voie"), F.col("type_voie"), F.col("libelle_voie")],
        F.col("code_commune"), F.col("code_postal"), F.col("libelle_commune"),
    )


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(etab_finess, siret, confidence) with the agreement levels behind it."""
    return (
        linkage.link(_centre_records(spark, sf_dir), _establishment_records(spark, sf_dir))
        .withColumnRenamed("l", "etab_finess")
        .withColumnRenamed("r", "siret")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_links(spark, sf_dir).select("etab_finess", "siret")


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of separate days: exact percentiles of each commune and day of loaded_at, by multi-select over that day's runs."""
    values = percentiles.clean_values(table(spark, sf_dir, "dvf_mutations"), "code_commune", "prix_m2", "loaded_at")
    runs = percentiles.day_runs(values.withColumn("g", F.concat_ws("|", "g", "day")), by_day=False)
    out = percentiles.percentiles(checkpoint(runs))
    return out.select(
        F.substring_index("g", "|", 1).alias("code_commune"), F.substring_index("g", "|", -1).cast("date").alias("jour"),
        F.col("n").alias("n_prix"), percentiles.rounded(F.col("p25")).alias("prix_m2_p25"), percentiles.rounded(F.col("p50")).alias("prix_m2_median"),
        percentiles.rounded(F.col("p75")).alias("prix_m2_p75"),
    )


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p25, median and p75 of prix_m2 per commune, by multi-select over runs of all days."""
    runs = percentiles.kept_runs(table(spark, sf_dir, "dvf_mutations"), "code_commune", "prix_m2", "loaded_at")
    return percentiles.percentiles(runs).select(
        F.col("g").alias("code_commune"), F.col("n").alias("n_prix"), percentiles.rounded(F.col("p25")).alias("prix_m2_p25"),
        percentiles.rounded(F.col("p50")).alias("prix_m2_median"), percentiles.rounded(F.col("p75")).alias("prix_m2_p75"),
    )


def p3_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the runs of separate days, each kept by itself and selected from together."""
    kept = percentiles.kept_runs(table(spark, sf_dir, "dvf_mutations"), "code_commune", "prix_m2", "loaded_at", by_day=True)
    return percentiles.percentiles(checkpoint(percentiles.merged(kept))).select(
        F.col("g").alias("code_commune"), F.col("n").alias("n_prix"), percentiles.rounded(F.col("p25")).alias("prix_m2_p25"),
        percentiles.rounded(F.col("p50")).alias("prix_m2_median"), percentiles.rounded(F.col("p75")).alias("prix_m2_p75"),
    )


def p3_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of separate days of loaded_at, combined, within the stated error."""
    values = percentiles.clean_values(table(spark, sf_dir, "dvf_mutations"), "code_commune", "prix_m2", "loaded_at")
    return percentiles.from_sketches(percentiles.day_sketches(values)).select(
        F.col("g").alias("code_commune"), F.col("n").alias("n_prix"), F.round("p25", 6).alias("prix_m2_p25"),
        F.round("p50", 6).alias("prix_m2_median"), F.round("p75", 6).alias("prix_m2_p75"),
    )


def _lengths(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return mixing.corpus_lengths(tokens.with_token_counts(table(spark, sf_dir, "documents"), columns))


def p8_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each kind, cut only where it alone exceeds the capacity."""
    return packing.layouts(_lengths(spark, sf_dir, ["doc_id"]), table(spark, sf_dir, "conteneurs"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space left unused per container kind."""
    return packing.usage(p8_layout(spark, sf_dir), table(spark, sf_dir, "conteneurs"))


def p8_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of the step groups per container kind."""
    return packing.step_balance(p8_layout(spark, sf_dir))


def p8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tier contributes to each container kind."""
    return packing.tier_usage(p8_layout(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: which text fills which slot, and its how-manieth use it is."""
    return mixing.mix(_lengths(spark, sf_dir, ["doc_id", "source"]), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged documents with the encoding pairs at work and the text restored as far as possible."""
    return encoding.repaired(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, siren, cost) of every directory row whose organisation is in the register."""
    communes = table(spark, sf_dir, "communes")
    register = variants.register_names(table(spark, sf_dir, "sirene_etablissements"), communes)
    return variants.link_names(register, variants.typed_names(table(spark, sf_dir, "annuaire_ameli"), communes))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_links(spark, sf_dir).select("id", "siren").distinct()


def _address_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    communes = table(spark, sf_dir, "communes")
    where = (F.col("code_insee"), F.col("code_postal"), F.col("ville"))
    people = places.address_fields(table(spark, sf_dir, "annuaire_ameli"), "id", [F.col("adresse")], communes, *where)
    fields = [F.col("voie"), F.col("complement_voie"), F.col("lieu_dit")]
    return people, places.address_fields(table(spark, sf_dir, "centres_sante"), "etab_finess", fields, communes, *where)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = places.same_addresses(*_address_sides(spark, sf_dir))
    return pairs.select(F.col("left_key").alias("id"), F.col("right_key").alias("etab_finess"))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the class of its address and the number of its links."""
    out = places.linked_members(*_address_sides(spark, sf_dir))
    return out.select(F.when(F.col("side") == "left", "annuaire").otherwise("centres").alias("liste"), F.col("key").alias("cle"), "place", "n_links")


QUERIES = {
    "p1_found": p1_found, "p1_links": p1_links,
    "p3_percentiles": p3_percentiles, "p3_daily": p3_daily, "p3_from_days": p3_from_days, "p3_by_days": p3_by_days,
    "p4_found": p4_found, "p4_links": p4_links,
    "p7_found": p7_found, "p7_places": p7_places,
    "p8_layout": p8_layout, "p8_usage": p8_usage, "p8_steps": p8_steps, "p8_tiers": p8_tiers,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_restored": p10_restored,
}

ORACLE: dict[str, str] = {
    "p3_daily": """
SELECT code_commune, jour, count(*) AS n_prix, round(quantile_cont(prix_m2, 0.25), 6) AS prix_m2_p25,
  round(quantile_cont(prix_m2, 0.5), 6) AS prix_m2_median, round(quantile_cont(prix_m2, 0.75), 6) AS prix_m2_p75
FROM (SELECT * EXCLUDE (loaded_at), CAST(min(loaded_at) AS DATE) AS jour FROM dvf_mutations GROUP BY ALL)
WHERE code_commune IS NOT NULL AND isfinite(prix_m2) AND prix_m2 > 0
GROUP BY code_commune, jour
""",
    **dict.fromkeys(("p3_percentiles", "p3_from_days"), """
SELECT code_commune, count(*) AS n_prix, round(quantile_cont(prix_m2, 0.25), 6) AS prix_m2_p25,
  round(quantile_cont(prix_m2, 0.5), 6) AS prix_m2_median, round(quantile_cont(prix_m2, 0.75), 6) AS prix_m2_p75
FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM dvf_mutations)
WHERE code_commune IS NOT NULL AND isfinite(prix_m2) AND prix_m2 > 0
GROUP BY code_commune
"""),
}
