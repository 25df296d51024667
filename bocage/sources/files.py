"""Readers for registry files: delimited text, nested JSON, and the choice of files of a catalogue.

Every column is read as text and typed by explicit expressions; nothing is inferred, so a
read is one pass and a changed file cannot change a schema.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bocage.functions import numbers, text
from bocage.sources import fs


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ";", quote: str | None = '"', columns: Sequence[str] | None = None,
    required: Iterable[str] = (), multi_line: bool = False, trim: bool = False, mode: str = "FAILFAST",
) -> DataFrame:
    """A delimited file with a header, all text, empty values as empty text; UTF-8, a leading mark dropped.

    Nothing is lost in silence: a row with too few or too many values, or with bytes that are not
    UTF-8, ends the read with an error.  ``read_with_rejects`` sets such rows apart instead.

    ``quote`` None reads quotes as ordinary characters.  ``columns`` prunes at the scan.  A
    missing ``required`` or selected column is an error, not a null.
    """
    # The parser sees whole rows, or a short one would pass where only its first columns are asked for.
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.option("quote", quote or "").option("escape", quote or "\\").option("multiLine", multi_line).option("mode", mode)
    reader = reader.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("emptyValue", "").option("nullValue", "")
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    absent = sorted({*required, *(columns or ())} - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    kept = df.select(*columns) if columns else df
    spoilt = F.lit("bytes that are not UTF-8")
    checked = [F.when(F.contains(F.col(f"`{c}`"), F.lit("\ufffd")), F.raise_error(spoilt)).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in kept.columns]
    return kept.select(*checked)


def read_with_rejects(spark: SparkSession, path: str | list[str], sep: str = ";", quote: str | None = '"') -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the rows that conform, and the raw text of the others with the reason, ``shape`` or ``bytes``.

    One record is one line; the header of the first file gives the columns.
    """
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    options = {"header": True, "sep": sep, "encoding": "UTF-8", "quote": quote or "", "escape": quote or "\\", "emptyValue": "", "nullValue": ""}
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{c.lstrip(chr(0xFEFF)).strip()}` string" for c in names) + ", _raw string"
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_raw", enforceSchema=True).schema(schema).csv(path)
    columns = [c for c in rows.columns if c != "_raw"]
    spoilt = F.contains(F.concat_ws("", *[f"`{c}`" for c in columns]), F.lit("\ufffd"))
    reason = F.when(F.col("_raw").isNotNull(), "shape").when(spoilt, "bytes")
    judged = rows.withColumn("_reason", reason)
    good = judged.where("_reason IS NULL").select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    raw = F.coalesce("_raw", F.concat_ws(sep, *[f"`{c}`" for c in columns]))
    return good, judged.where("_reason IS NOT NULL").select(raw.alias("raw"), F.col("_reason").alias("reason"))


def tokens(line: Column, sep: str = ";") -> Column:
    """The values of one delimited line; quotes group, doubled quotes stand for one."""
    body = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^' + re.escape(sep) + r'"]*+)'
    fields = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{re.escape(sep)}({body})"), F.lit(1))
    return F.transform(
        fields,
        lambda v: F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v),
    )


SITE_SCHEMA = T.StructType(
    [
        T.StructField(
            "informationsGeneralesEGE",
            T.StructType([T.StructField(c, T.StringType()) for c in ("numFinessEge", "nomEgeLong", "nomEgeCourt", "dateOuverture", "dateFermeture", "siret")]),
        ),
        T.StructField("categorieentiteGeographiqueExercice", T.StringType()),
        T.StructField(
            "adresse",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.StringType()) for c in ("usageAdresse", "numeroVoie", "typeVoie", "libelleVoie", "cogCommune", "ligneAcheminement", "codePostal")]
                    + [
                        T.StructField(
                            "coordonneesGeographique",
                            T.StructType([T.StructField(c, T.StringType()) for c in ("coordonneeX", "coordonneeY", "cleInInteropBAN", "scoreBAN")]),
                        )
                    ]
                )
            ),
        ),
        T.StructField("contact", T.ArrayType(T.StructType([T.StructField("telephone", T.StringType()), T.StructField("email", T.StringType())]))),
        T.StructField("etatObjet", T.StringType()),
    ]
)


def read_sites(spark: SparkSession, path: str, under: str | None = None, lines: bool = False) -> DataFrame:
    """Sites out of nested JSON: the geographic address (usage 03), the first contact that has a value,
    cleaned names, and the reason why a site cannot be loaded, if any.

    ``under`` names the array of legal entities that holds their sites: each entity gives a row a
    site.  ``lines`` reads one object a line, so that a large file is split among tasks; without it
    a file is one JSON array and one task.
    """
    schema = SITE_SCHEMA if under is None else T.StructType([T.StructField(under, T.ArrayType(SITE_SCHEMA))])
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    if under is not None:
        raw = raw.select(F.explode(under).alias("_site")).select("_site.*")
    general = "informationsGeneralesEGE"
    place = F.try_element_at(F.filter("adresse", lambda a: a["usageAdresse"] == "03"), F.lit(1))
    spot = F.col("place.coordonneesGeographique")
    contact = lambda c: F.try_element_at(F.filter(F.transform("contact", lambda x: text.non_empty(x[c])), lambda v: v.isNotNull()), F.lit(1))
    df = raw.withColumn("place", place)
    number, commune = text.non_empty(F.col(f"{general}.numFinessEge")), text.non_empty(F.col("place.cogCommune"))
    reason = (
        F.when(text.non_empty(F.col(f"{general}.dateFermeture")).isNotNull(), "closed")
        .when(number.isNull(), "no_id")
        .when(~number.rlike(r"^[0-9AB]{9}\z"), "bad_id")
        .when(F.col("place").isNull(), "no_address")
        .when(commune.isNull(), "no_commune")
        .when(~commune.rlike(r"^[0-9][0-9AB][0-9]{3}\z"), "bad_commune")
    )
    x, y = numbers.strict_number(spot["coordonneeX"]), numbers.strict_number(spot["coordonneeY"])
    usable = F.coalesce(x.between(-180, 180) & y.between(-90, 90) & ~((x == 0) & (y == 0)), F.lit(False))
    return df.select(
        number.alias("num_finess"),
        F.coalesce(text.clean_text(F.col(f"{general}.nomEgeLong")), text.clean_text(F.col(f"{general}.nomEgeCourt"))).alias("name"),
        text.non_empty(F.col("categorieentiteGeographiqueExercice")).alias("category"), text.non_empty(F.col(f"{general}.siret")).alias("siret"),
        F.concat_ws(" ", text.non_empty(F.col("place.numeroVoie")), text.non_empty(F.col("place.typeVoie")), text.non_empty(F.col("place.libelleVoie"))).alias("street"),
        text.non_empty(F.col("place.codePostal")).alias("postal"), commune.alias("commune"), numbers.strict_date(F.col(f"{general}.dateOuverture")).alias("opened"),
        F.when(usable, x).alias("lon"), F.when(usable, y).alias("lat"), text.first_phone(contact("telephone")).alias("phone"), contact("email").alias("email"),
        reason.alias("skip_reason"),
    )


def wanted_sales_files(names: Iterable[str]) -> list[str]:
    """The latest two files of a sales catalogue: a full-year file retires that year's half-years; fewer than two is an error."""
    found = {}
    for name in names:
        m = re.search(r"full-(\d{4})(?:-s([12]))?\.csv\.gz$", name)
        if m:
            found[(int(m[1]), int(m[2] or 0))] = name
    whole = {year for year, half in found if half == 0}
    kept = sorted((y, h or 9, n) for (y, h), n in found.items() if h == 0 or y not in whole)
    if len(kept) < 2:
        raise ValueError("fewer than two sales files in the catalogue")
    return [n for _, _, n in kept[-2:]]


def mapped_columns(df: DataFrame, mapping: Mapping[str, str], key: str) -> DataFrame:
    """A key and loosely parsed numbers, renamed by a declared mapping of source to target."""
    return df.select(key, *[numbers.loose_number(F.col(source)).alias(target) for source, target in mapping.items()])


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return fs.digest(spark, path)


def precheck(spark: SparkSession, path: str, least_bytes: int, magic: bytes = b"") -> None:
    """Refuse files that are too small or not of the expected kind, before any job starts."""
    size, _ = fs.status(spark, path)
    if size < least_bytes:
        raise ValueError(f"{path}: {size} bytes, expected at least {least_bytes}")
    if fs.head(spark, path, len(magic)) != magic:
        raise ValueError(f"{path}: unexpected first bytes")


def fresh(spark: SparkSession, path: str, ttl_seconds: float, now: float | None = None) -> bool:
    """Whether a cached file exists and is younger than its time to live."""
    return fs.exists(spark, path) and (now or time.time()) - fs.status(spark, path)[1] < ttl_seconds
