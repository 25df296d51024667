"""Numbers and dates as Column expressions: strict and loose parsing, rounding, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_number(text: Column) -> Column:
    """Only plain decimals with an optional minus; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^-?\d+(\.\d+)?\z"), trimmed).try_cast("double")


def loose_number(text: Column) -> Column:
    """Decimal commas allowed; blank or unreadable text is null."""
    number = F.nullif(F.trim(F.replace(text, F.lit(","), F.lit("."))), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number), number)


def loose_coordinate(text: Column) -> Column:
    """The number a text starts with, its first comma read as a point."""
    dotted = F.regexp_replace(text, r"^([^,]*),", "$1.")
    return F.nullif(F.regexp_extract(dotted, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def strict_boolean(text: Column) -> Column:
    """True only for the word true in any case; everything else is false."""
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def boolean_fallback(text: Column) -> Column:
    """Whether ``strict_boolean`` had to guess."""
    return ~F.coalesce(F.lower(F.trim(text)).isin("true", "false"), F.lit(False))


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding half towards plus infinity, which differs from ``round`` below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def km(metres: Column) -> Column:
    """Kilometres with two decimals; null and NaN are null."""
    return F.when(~F.isnan(metres), round_half_up(metres / 1000.0, 2))


def count_label(n: Column) -> Column:
    """Compact counts: 999, 1.5K, 12K, 1.5M, 12M; null is empty, negatives stay as they are."""
    one = lambda unit: F.format_string("%.1f", F.round(n / F.lit(unit), 1))
    whole = lambda unit: F.floor(n / F.lit(unit)).cast("string")
    return (
        F.when(n.isNull(), "")
        .when(n >= 10_000_000, F.concat(whole(1_000_000), F.lit("M")))
        .when(n >= 1_000_000, F.concat(one(1_000_000), F.lit("M")))
        .when(n >= 10_000, F.concat(whole(1_000), F.lit("K")))
        .when(n >= 1_000, F.concat(one(1_000), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def strict_date(text: Column) -> Column:
    """Calendar dates YYYY-MM-DD from 1900 on; anything else is null."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")
    return F.when(day >= F.lit("1900-01-01").cast("date"), day)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_number(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def month_lag(later: Column, earlier: Column) -> Column:
    """Whole months between two dates' months."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def age_days(now: Column, at: Column) -> Column:
    """Whole days between two instants, rounded down."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    return F.floor(seconds / 86_400).cast("int")
