"""Row mappers: raw registry records to typed rows, each with the reason why it cannot be loaded, if any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.functions import codes, numbers, text


def practitioner_rows(raw: DataFrame) -> DataFrame:
    """Directory records: either name stands in for the other, address parts joined, types 3 and 4 skipped."""
    c = {name: text.non_empty(F.col(name)) for name in raw.columns}
    last, first = F.coalesce(c["ps_activite_nom"], c["ps_activite_prenom"]), F.coalesce(c["ps_activite_prenom"], c["ps_activite_nom"])
    reason = (
        F.when(c["type_ps_code"].isin("3", "4"), "type")
        .when(last.isNull(), "no_name")
        .when(c["coordonnees_code_postal"].isNull() & c["code_insee"].isNull(), "no_place")
    )
    return raw.select(
        c["id_ligne"].alias("id_ligne"), last.alias("nom"), first.alias("prenom"), c["ps_activite_raison_sociale"].alias("raison_sociale"),
        text.non_empty(F.concat_ws(", ", c["coordonnees_voie"], c["coordonnees_complement"])).alias("adresse"),
        codes.postal_prefix(c["coordonnees_code_postal"]).alias("code_postal"), c["coordonnees_ville"].alias("ville"), c["code_insee"].alias("code_insee"),
        F.coalesce(codes.department_of_insee(c["code_insee"]), codes.department_of_postal(c["coordonnees_code_postal"])).alias("code_departement"),
        text.first_phone(c["coordonnees_num_tel"]).alias("telephone"), reason.alias("skip_reason"),
    )


def activity_rows(raw: DataFrame, key: str, last: str, first: str, address: list[str], postal: str) -> DataFrame:
    """One row per practitioner and activity: rows without key or names drop, address parts join by blanks."""
    parts = F.concat_ws(" ", *[text.non_empty(F.col(a)) for a in address])
    return raw.select(
        text.non_empty(F.col(key)).alias("rpps_id"), text.non_empty(F.col(last)).alias("nom"), text.non_empty(F.col(first)).alias("prenom"),
        text.non_empty(parts).alias("adresse"), F.substring(F.trim(postal), 1, 5).alias("code_postal"),
    ).where("rpps_id IS NOT NULL AND nom IS NOT NULL AND prenom IS NOT NULL")


def centre_rows(raw: DataFrame) -> DataFrame:
    """Health centres: identifiers checked, unknown names and types made plain, strict booleans."""
    default = lambda c: F.coalesce(text.clean_text(F.col(c)), F.lit("_unknown_")).alias(c)
    number = F.trim("etab_finess")
    return raw.select(
        number.alias("etab_finess"), default("etab_raison_sociale"), default("type_etab_libelle"), text.non_empty(F.col("voie")).alias("voie"),
        codes.department_of_postal(F.col("code_postal")).alias("dep"), F.when(~codes.valid(number, codes.FINESS), "bad_id").alias("skip_reason"),
    )


def clarified(df: DataFrame, code: str, label: str, overrides: dict[str, tuple[str, str]]) -> Column:
    """Labels replaced where a code still carries the ambiguous wording known for it, and only there."""
    out = F.col(label)
    for value, (known, clear) in overrides.items():
        out = F.when((F.col(code) == value) & (F.col(label) == known), clear).otherwise(out)
    return out


def geocode_confidence(score: Column, kind: Column) -> Column:
    """low, or ok, by the least score of each kind of result."""
    least = F.when(kind == "housenumber", 0.7).when(kind.isin("street", "locality"), 0.6).otherwise(0.5)
    return F.when(F.coalesce(score < least, F.lit(True)), "low").otherwise("ok")


def current_period(periods: Column) -> dict[str, Column]:
    """State of an establishment from its periods (from, until, state): active, first day, closing day."""
    open_ones = F.filter(periods, lambda p: p["until"].isNull())
    now = F.try_element_at(open_ones, F.lit(1))
    active = F.coalesce(now["state"] == "A", F.lit(False))
    return {"active": active, "created": F.array_min(F.transform(periods, lambda p: p["from"])), "closed": F.when(~active, now["from"])}


def precision_summary(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per group whether its points are all precise, all centroids or mixed; rows without label are ignored."""
    n, exact = F.count(label), F.count_if(F.col(label) == "precise")
    return df.groupBy(*keys).agg(F.when(n == 0, None).when(exact == n, "precise").when(exact == 0, "centroid").otherwise("mixed").alias("precision"), n.alias("n_labelled"))


def period_label(first: Column, last: Column) -> Column:
    """One year, or the span between two."""
    a, b = F.year(first).cast("string"), F.year(last).cast("string")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Text columns as numbers or dates by strict rules; what does not read is null."""
    readers = {"number": numbers.strict_number, "loose": numbers.loose_number, "date": numbers.strict_date, "boolean": numbers.strict_boolean}
    return df.withColumns({column: readers[kind](F.col(column)) for column, kind in kinds.items()})
