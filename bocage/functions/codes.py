"""Official codes as Column expressions: validity, départements, districts, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPARTMENT = r"^(?:\d{2}|2A|2B|97[1-8]|98[4-8])\z"
EXISTING_DEPARTMENT = r"^(?:0[1-9]|1\d|2[1-9]|[3-8]\d|9[0-5]|2A|2B|97[1-8]|98[4-8])\z"
INSEE = r"^[0-9][0-9AB][0-9]{3}\z"
FINESS = r"^\d{9}\z"
SIRET = r"^\d{14}\z"
SIREN = r"^\d{9}\z"
RPPS = r"^\d{11,12}\z"
IRIS = r"^(?:\d{2}|2A|2B)\d{7}\z"

#: (parent commune, first and last district code) of the three cities with districts; fixed values.
DISTRICTS = (("75056", "75101", "75120"), ("69123", "69381", "69389"), ("13055", "13201", "13216"))


def valid(code: Column, pattern: str) -> Column:
    """False, never null, for what does not match."""
    return F.coalesce(code.rlike(pattern), F.lit(False))


def valid_department(code: Column) -> Column:
    return valid(code, DEPARTMENT) & (code != "20")


def department_of_insee(code: Column) -> Column:
    """Corsica keeps its letter, overseas codes three digits; too short is null."""
    return (
        F.when(code.startswith("2A") | code.startswith("2B"), F.substring(code, 1, 2))
        .when(code.startswith("97") | code.startswith("98"), F.when(F.length(code) >= 3, F.substring(code, 1, 3)))
        .when(F.length(code) >= 2, F.substring(code, 1, 2))
    )


def department_of_postal(postal: Column) -> Column:
    """Null for Corsica, which the postal code leaves open, and for départements that do not exist."""
    five = F.regexp_extract(F.trim(postal), r"^(\d{5})", 1)
    guess = F.when(five.rlike("^9[78]"), F.substring(five, 1, 3)).otherwise(F.substring(five, 1, 2))
    return F.when(~five.startswith("20") & guess.rlike(EXISTING_DEPARTMENT), guess)


def postal_prefix(text: Column) -> Column:
    """Leading five digits, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d{5})", 1), F.lit(""))


def siren_of_siret(siret: Column) -> Column:
    return F.substring(siret, 1, 9)


def naf_key(code: Column) -> Column:
    """Activity code without dots, in capitals."""
    return F.upper(F.replace(F.trim(code), F.lit("."), F.lit("")))


def parent_commune(code: Column) -> Column:
    """The city of a district code; other codes are their own parents."""
    out = code
    for parent, low, high in DISTRICTS:
        out = F.when(code.between(low, high), parent).otherwise(out)
    return out


def district_range(parent: str) -> tuple[str, str]:
    """First and last code that belong to a commune: its districts, or itself."""
    return next(((low, high) for p, low, high in DISTRICTS if p == parent), (parent, parent))
