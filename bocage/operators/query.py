"""Filters, look-ups and top-k as operators: optional conditions, radius scans, hybrid unions, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bocage.functions import geo

LIMIT_MAX, OFFSET_MAX, RADIUS_KM = 500, 100_000, (0.1, 50.0)


def check_limit(limit: int, offset: int = 0) -> None:
    """Bounds of a page; outside them a ValueError."""
    if not 1 <= limit <= LIMIT_MAX:
        raise ValueError(f"limit must lie between 1 and {LIMIT_MAX}")
    if not 0 <= offset <= OFFSET_MAX:
        raise ValueError(f"offset must lie between 0 and {OFFSET_MAX}")


def check_point(lon: float, lat: float, radius_km: float) -> None:
    """Bounds of a radius query; outside them a ValueError."""
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError("longitude or latitude off the globe")
    if not RADIUS_KM[0] <= radius_km <= RADIUS_KM[1]:
        raise ValueError(f"radius must lie between {RADIUS_KM[0]} and {RADIUS_KM[1]} km")


def exactly_one(**scopes) -> str:
    """The name of the only scope given; none or several is a ValueError."""
    given = [name for name, value in scopes.items() if value is not None]
    if len(given) != 1:
        raise ValueError(f"give exactly one of {', '.join(scopes)}")
    return given[0]


def optional_equal(df: DataFrame, column: str, value) -> DataFrame:
    """No value, no condition."""
    return df if value is None else df.where(F.col(column) == value)


def optional_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """An empty list is no condition."""
    return df.where(F.col(column).isin(list(values))) if values else df


def lenient_category(df: DataFrame, column: str, values: Sequence[str] | None, default: Sequence[str] = ("C",)) -> DataFrame:
    """Rows of the categories, or of none: an unknown category is never held against a row."""
    return df.where(F.col(column).isin(list(values or default)) | F.col(column).isNull())


def overlapping(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose array shares an element with the list; an empty list is no condition."""
    return df.where(F.arrays_overlap(column, F.array(*map(F.lit, values)))) if values else df


def unknown_codes(codes: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Requested codes the dictionary lacks; an empty dictionary proves nothing, so none are."""
    some = dictionary.limit(1).select(F.lit(1).alias("_some"))
    missing = codes.select(code).distinct().join(dictionary.select(code).distinct(), code, "left_anti")
    return missing.withColumn("_some", F.lit(1)).join(some, "_some", "left_semi").drop("_some")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Refuse to answer from an empty table."""
    if df.isEmpty():
        raise LookupError(f"{what} is empty: no count can be trusted")
    return df


def with_point(df: DataFrame, geom: str = "geom") -> DataFrame:
    """``lon`` and ``lat`` of usable points; other rows drop out."""
    placed = df.withColumns({"lon": geo.point_lon(F.col(geom)), "lat": geo.point_lat(F.col(geom))})
    return placed.where(geo.usable_point(F.col("lon"), F.col("lat")))


def in_radius(df: DataFrame, lon: float, lat: float, radius_m: float) -> DataFrame:
    """Rows within the radius, inclusive, with their ``distance_m``; the box reaches the scan."""
    metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat)))
    return df.where(geo.bbox_filter(F.col("lon"), F.col("lat"), lon, lat, radius_m)).withColumn("distance_m", metres).where(
        F.col("distance_m") <= radius_m
    )


def nearest(df: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The closest rows first, ties by the given columns."""
    return df.orderBy("distance_m", *ties).limit(limit)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    check_limit(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def truncated(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows, each with whether more exist: one row too many is fetched to know."""
    more = df.orderBy(*order).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))
    flagged = more.withColumns({"_n": n, "truncated": F.count("*").over(Window.partitionBy(F.lit(1))) > limit})
    return flagged.where(F.col("_n") <= limit).drop("_n")


def after_key(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset page: rows beyond the cursor in key order."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def first_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes first, combined before the shuffle."""
    rows = [F.col(c) for c in df.columns]
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*rows), F.col(order)).alias("_row"))
    # The key comes from the grouping, so a filter on it passes below.
    return best.select(*[F.col(f"_{c}").alias(c) if c in key else F.col("_row").getField(c).alias(c) for c in df.columns])


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the row of each key with the greatest order, combined before the shuffle."""
    rows = [F.col(c) for c in df.columns]
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(F.struct(*rows), F.struct(*order)).alias("_row"))
    # The key comes from the grouping, so a filter on it passes below.
    return best.select(*[F.col(f"_{c}").alias(c) if c in key else F.col("_row").getField(c).alias(c) for c in df.columns])


def last_near(df: DataFrame, key: Sequence[str], order: Sequence[str], lon: float, lat: float, radius_m: float, geom: str = "geom") -> DataFrame:
    """Rows whose last version lies within the radius: only keys with any version in its box are brought together."""
    box = geo.bbox_filter(geo.point_lon(F.col(geom)), geo.point_lat(F.col(geom)), lon, lat, radius_m)
    close = df.where(box).select(*key).distinct()
    return in_radius(with_point(last_per_key(df.join(close, list(key), "left_semi"), key, order), geom), lon, lat, radius_m)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (planned with a group limit before the shuffle)."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def hybrid_radius(
    rows: DataFrame, centroids: DataFrame, group: str, lon: float, lat: float, radius_m: float, limit: int, tie: str,
    precise_only: bool = False,
) -> DataFrame:
    """Precise rows within the radius and, for the others, those of the groups whose centroid is.

    Both branches are cut to ``limit`` before the union, as each could fill the answer alone;
    the imprecise one takes at most ``limit`` rows of each group.
    """
    columns = [*[c for c in rows.columns if c not in ("lon", "lat", "precise")], "distance_m", "precision"]
    near = nearest(in_radius(rows.where("precise"), lon, lat, radius_m), limit, tie).withColumn("precision", F.lit("precise"))
    if precise_only:
        return near.select(columns)
    spots = in_radius(centroids, lon, lat, radius_m).select(group, "distance_m")
    vague = rows.where("NOT precise").drop("lon", "lat").join(spots, group)
    vague = top_per_group(vague, [group], [F.col(tie)], limit).withColumn("precision", F.lit("centroid"))
    return nearest(near.select(columns).unionByName(nearest(vague, limit, tie).select(columns)), limit, tie)
