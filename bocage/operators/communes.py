"""Commune resolution cascade: a declared code, else postal code and name, else one alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.functions.codes import department_of_postal
from bocage.functions.text import commune_key

MISSPELT = 2


def _unique(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Codes that are the only ones of their key; ambiguous keys resolve to nothing."""
    return (
        df.where(F.expr(" AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)))
        .groupBy(*keys)
        .agg(F.min("c_code").alias(out), F.max("c_code").alias("c_last"))
        .where(F.col(out) == F.col("c_last"))
        .drop("c_last")
    )


def with_commune(
    df: DataFrame, communes: DataFrame, code: Column, postal: Column, town: Column, out: str = "commune"
) -> DataFrame:
    """``df`` plus the commune code: declared, else by (postal, name), (département, name), a name
    misspelt by up to two letters under its postal code, the postal code alone, or, where no
    postal code is given, the name alone.

    Only unambiguous look-ups count; rows none of them resolves keep null.  The look-up
    tables derive from the official list of communes; Spark broadcasts them only where
    their measured size allows.
    """
    base = communes.where(F.col("code_insee").isNotNull()).select(
        F.col("code_insee").alias("c_code"),
        commune_key(F.col("nom")).alias("c_name"),
        F.col("code_departement").alias("c_dep"),
        F.col("codes_postaux").alias("c_posts"),
    )
    by_post = base.select("c_code", "c_name", F.explode_outer("c_posts").alias("c_post"))
    exact = _unique(by_post, ["c_post", "c_name"], "c_exact")
    in_dep = _unique(base, ["c_dep", "c_name"], "c_in_dep")
    alone = _unique(by_post, ["c_post"], "c_alone")
    by_name = _unique(base, ["c_name"], "c_by_name")
    # A postal code serves a few communes at most, so this array stays short.
    served = by_post.groupBy(F.col("c_post").alias("s_post")).agg(F.collect_set(F.struct("c_name", "c_code")).alias("s_list"))
    declared = F.when(F.trim(code).rlike("^[0-9][0-9AB][0-9]{3}$"), F.trim(code))
    row = df.select(
        "*", declared.alias("r_code"), F.nullif(F.trim(postal), F.lit("")).alias("r_post"), commune_key(town).alias("r_name"),
        department_of_postal(F.trim(postal)).alias("r_dep"),
    )
    joined = (
        row.join(exact, (F.col("r_post") == exact["c_post"]) & (F.col("r_name") == exact["c_name"]), "left")
        .drop("c_post", "c_name")
        .join(in_dep, (F.col("r_dep") == in_dep["c_dep"]) & (F.col("r_name") == in_dep["c_name"]), "left")
        .drop("c_dep", "c_name")
        .join(alone, F.col("r_post") == alone["c_post"], "left")
        .join(served, F.col("r_post") == served["s_post"], "left")
        .join(by_name, F.col("r_name") == by_name["c_name"], "left")
    )
    alike = F.filter("s_list", lambda s: F.levenshtein(s["c_name"], F.col("r_name")) <= MISSPELT)
    misspelt = F.when((F.size(alike) == 1) & (F.length("r_name") >= 6), F.element_at(alike, 1)["c_code"])
    lone_name = F.when(F.col("r_post").isNull(), F.col("c_by_name"))
    code_out = F.coalesce("r_code", "c_exact", "c_in_dep", misspelt, "c_alone", lone_name)
    return joined.withColumn(out, code_out).drop(
        "r_code", "r_post", "r_name", "r_dep", "c_exact", "c_in_dep", "c_alone", "c_post", "s_post", "s_list",
        "c_by_name", "c_name",
    )
