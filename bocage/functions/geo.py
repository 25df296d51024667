"""Geometry as Column expressions: points and polygons in EWKT, great circles, boxes.

The sphere of radius 6 371 000 m is used throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0

_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_POINT = rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"


def point_lon(geom: Column) -> Column:
    """Longitude of an EWKT point; null for anything else, POINT EMPTY included."""
    return F.regexp_extract(geom, _POINT, 1).try_cast("double")


def point_lat(geom: Column) -> Column:
    """Latitude of an EWKT point; null for anything else."""
    return F.regexp_extract(geom, _POINT, 2).try_cast("double")


def usable_point(lon: Column, lat: Column) -> Column:
    """True for coordinates on the globe other than the (0, 0) placeholder."""
    return F.coalesce(
        lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~((lon == 0.0) & (lat == 0.0)),
        F.lit(False),
    )


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres, clamped so rounding cannot leave asin's domain."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bbox_filter(lon: Column, lat: Column, lon0: float, lat0: float, radius_m: float) -> Column:
    """A box slightly larger than the circle; plain ranges, so Parquet statistics prune on it."""
    km = radius_m / 1000.0
    dlat = km / 111.0
    dlon = km / (111.0 * max(0.01, math.cos(math.radians(lat0))))
    return lat.between(lat0 - dlat, lat0 + dlat) & lon.between(lon0 - dlon, lon0 + dlon)


def within_radius(lon: Column, lat: Column, lon0: float, lat0: float, radius_m: float) -> Column:
    """Inclusive radius predicate: pushed-down box first, exact great circle second."""
    exact = haversine_m(lon, lat, F.lit(float(lon0)), F.lit(float(lat0))) <= radius_m
    return bbox_filter(lon, lat, lon0, lat0, radius_m) & exact


def polygon_rings(geom: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON as array<array<struct<x,y>>>; empty if it has none.

    Holes and separate pieces need no marking: parity over all rings counts them right.
    """
    body = F.when(geom.rlike(r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(?:MULTI)?POLYGON"), geom)
    texts = F.regexp_extract_all(body, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def vertex(pair: Column) -> Column:
        parts = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.try_element_at(parts, F.lit(1)).try_cast("double").alias("x"),
            F.try_element_at(parts, F.lit(2)).try_cast("double").alias("y"),
        )

    rings = F.transform(texts, lambda ring: F.transform(F.split(ring, ","), vertex))
    whole = F.filter(rings, lambda ring: (F.size(ring) >= 3) & ~F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull()))
    return F.coalesce(whole, F.array().cast("array<array<struct<x:double,y:double>>>"))


def ring_edges(ring: Column) -> Column:
    """Edges of one ring, closed whether or not the last vertex repeats the first."""
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p["x"].alias("x1"),
            p["y"].alias("y1"),
            F.element_at(ring, ((i + 1) % F.size(ring)) + 1)["x"].alias("x2"),
            F.element_at(ring, ((i + 1) % F.size(ring)) + 1)["y"].alias("y2"),
        ),
    )


#: Lambert-93 on the GRS80 ellipsoid: exponent, constant, pole and eccentricity; fixed values.
_L93_N, _L93_C, _L93_X, _L93_Y, _L93_E = 0.725607765053267, 11754255.426096, 700000.0, 12655612.049876, 0.0818191910428158


def lambert93_lon(x: Column, y: Column) -> Column:
    """Longitude in degrees of Lambert-93 metres."""
    return F.lit(3.0) + F.degrees(F.atan2(x - _L93_X, F.lit(_L93_Y) - y)) / _L93_N


def lambert93_lat(x: Column, y: Column) -> Column:
    """Latitude in degrees of Lambert-93 metres: the conformal latitude and its series in the eccentricity."""
    radius = F.sqrt(F.pow(x - _L93_X, 2) + F.pow(y - _L93_Y, 2))
    chi = 2 * F.atan(F.pow(F.lit(_L93_C) / radius, 1 / _L93_N)) - math.pi / 2
    e2 = _L93_E**2
    terms = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    phi = chi
    for k, term in enumerate(terms, 1):
        phi = phi + F.lit(term) * F.sin(2 * k * chi)
    return F.degrees(phi)


def in_france(lon: Column, lat: Column) -> Column:
    """Coordinates within the box that holds mainland and overseas France."""
    return F.coalesce(lon.between(-65.0, 60.0) & lat.between(-25.0, 52.0), F.lit(False))


def resolved_point(lon: Column, lat: Column, x: Column, y: Column) -> dict[str, Column]:
    """Degrees where usable, else projected metres turned into degrees, else null; with the layout used."""
    direct = usable_point(lon, lat)
    projected = F.coalesce(x.between(0.0, 1.3e6) & y.between(6.0e6, 7.2e6), F.lit(False))
    return {
        "lon": F.when(direct, lon).when(projected, lambert93_lon(x, y)),
        "lat": F.when(direct, lat).when(projected, lambert93_lat(x, y)),
        "layout": F.when(direct & projected, "degrees_first").when(direct, "degrees_only").when(projected, "projected_only").otherwise("unusable"),
    }
