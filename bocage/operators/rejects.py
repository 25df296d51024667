"""Problem 2: rows that fail to parse.

A strict load keeps only records that conform in every respect.  Subtracting their
offsets from all offsets (anti-join) leaves the records to diagnose, so a record is
either loaded or reported, never both and never neither.

Defined results: a null record is no record with 15 fields, hence ``column_count``; the
empty record likewise.  A null ``raw_id`` is kept as an offset of its own (offsets are
compared null-safe together with a digest of the record).  Repeated records are each
loaded or reported under their own offset.  Extra columns of the input are ignored, names
that clash with the output included.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The record layout: fixed values, in file order.
FIELDS = (
    "id_ligne", "type_ps_code", "ps_activite_nom", "ps_activite_prenom", "ps_activite_raison_sociale",
    "specialite_code", "coordonnees_voie", "coordonnees_complement", "coordonnees_code_postal",
    "coordonnees_ville", "code_insee", "coordonnees_num_tel", "date_maj", "longitude", "latitude",
)

# Possessive throughout: linear time, no recursion on very long records.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^";]*+)'
_RECORD = rf"(?s)\A{_FIELD}(?:;{_FIELD})*+\z"
_EACH = rf"(?s);({_FIELD})"

_DIGITS = r"\A[0-9]+\z"
_POSTAL = r"\A[0-9]{5}\z"
_INSEE = r"\A(?:0[1-9]|[1-8][0-9]|9[0-5]|97|98|2A|2B)[0-9]{3}\z"
_DATE = r"\A(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\z"
_DECIMAL = r"\A[-+]?[0-9]+(?:\.[0-9]+)?\z"


def _body(raw: Column) -> Column:
    """The record without the one line end that may follow its last value."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?:\r\n|\n|\r)\z", "")


def _values(body: Column) -> Column:
    """Field values of a well-quoted record: outer quotes gone, doubled quotes single."""
    # A leading separator gives every field one, so an empty first field is not skipped.
    fields = F.regexp_extract_all(F.concat(F.lit(";"), body), F.lit(_EACH), F.lit(1))
    return F.transform(
        fields,
        lambda v: F.when(
            v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(v),
    )


def _blank_trim(value: Column) -> Column:
    return F.regexp_replace(value, r"\A[\s  ]+|[\s  ]+\z", "")


def _field(values: Column, name: str) -> Column:
    return _blank_trim(F.try_element_at(values, F.lit(FIELDS.index(name) + 1)))


def _coordinate_ok(value: Column, bound: float) -> Column:
    number = F.when(value.rlike(_DECIMAL), value).try_cast("double")
    return (value == "") | F.coalesce(number.between(-bound, bound), F.lit(False))


def _rules(values: Column) -> list[tuple[str, Column]]:
    """(reason, holds) in the order in which the first failure is reported."""
    day = _field(values, "date_maj")
    real_day = F.when(day.rlike(_DATE), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).isNotNull()
    insee, postal = _field(values, "code_insee"), _field(values, "coordonnees_code_postal")
    return [
        ("id_ligne", _field(values, "id_ligne").rlike(_DIGITS)),
        ("code_postal", (postal == "") | postal.rlike(_POSTAL)),
        ("code_insee", (insee == "") | insee.rlike(_INSEE)),
        ("date_maj", (day == "") | real_day),
        (
            "coordonnee",
            _coordinate_ok(_field(values, "longitude"), 180.0) & _coordinate_ok(_field(values, "latitude"), 90.0),
        ),
    ]


def _offsets(records: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    return records.select(
        F.col(id_col).alias("raw_id"),
        _body(F.col(raw_col)).alias("body"),
        F.xxhash64(F.coalesce(F.col(raw_col), F.lit("\u0000"))).alias("digest"),
    )


def _conforming(offsets: DataFrame) -> DataFrame:
    parsed = offsets.where(F.col("body").rlike(_RECORD)).withColumn("values", _values(F.col("body")))
    ok = F.size("values") == len(FIELDS)
    for _, holds in _rules(F.col("values")):
        ok = ok & holds
    return parsed.where(ok)


def strict_load(records: DataFrame, id_col: str = "raw_id", raw_col: str = "raw") -> DataFrame:
    """Conforming records as 15 typed columns after their offset; empty values are null."""
    values = F.col("values")
    text = {name: F.nullif(_field(values, name), F.lit("")) for name in FIELDS}
    typed = {
        **text,
        "id_ligne": text["id_ligne"].try_cast("decimal(38,0)"),
        "date_maj": text["date_maj"].try_cast("date"),
        "longitude": text["longitude"].try_cast("double"),
        "latitude": text["latitude"].try_cast("double"),
    }
    return _conforming(_offsets(records, id_col, raw_col)).select(
        "raw_id", *(typed[name].alias(name) for name in FIELDS)
    )


def rejected(records: DataFrame, id_col: str = "raw_id", raw_col: str = "raw") -> DataFrame:
    """(raw_id, reason) of every record the strict load did not take, first reason only."""
    offsets = _offsets(records, id_col, raw_col)
    loaded = _conforming(offsets).select(F.col("raw_id").alias("l_id"), F.col("digest").alias("l_digest"))
    rest = offsets.join(
        loaded,
        offsets["raw_id"].eqNullSafe(loaded["l_id"]) & (offsets["digest"] == loaded["l_digest"]),
        "left_anti",
    )
    quoted = F.col("body").rlike(_RECORD)
    rest = rest.withColumn("values", F.when(quoted, _values(F.col("body"))))
    reason = F.when(F.col("values").isNull(), "quoting").when(F.size("values") != len(FIELDS), "column_count")
    for name, holds in _rules(F.col("values")):
        reason = reason.when(~holds, name)
    return rest.select("raw_id", reason.alias("reason")).distinct()
