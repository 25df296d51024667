"""Problem 5: points near other points, and regions that contain them.

Containment is crossing parity in SQL: polygon edges are binned into latitude strips,
points meet only the edges of their own strip, and the ray crossings are counted by point
and region.  Nearness is an equi-join on grid cells followed by the exact distance.

Defined results: points that are null, empty, malformed, off the globe or at (0, 0) take
no part.  A point on an edge or vertex, of a hole too, is contained.  A region repeated in
several rows counts once, however its rows are spelled.  Repeated points give repeated
keys once.  The radius is inclusive and works across the antimeridian.  Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.functions.geo import (
    METRES_PER_DEGREE, haversine_m, point_lat, point_lon, polygon_rings, ring_edges, usable_point,
)
from bocage.session import checkpoint

STRIP_DEGREES = 0.01
COLUMN_DEGREES = 0.1
EDGE_TOLERANCE = 1e-12


def located(df: DataFrame, key: Column, geom: str = "geom", key_name: str = "key") -> DataFrame:
    """(key, lon, lat) of the rows whose geometry is a usable point."""
    points = df.select(key.alias(key_name), point_lon(F.col(geom)).alias("lon"), point_lat(F.col(geom)).alias("lat"))
    return points.where(F.col(key_name).isNotNull() & usable_point(F.col("lon"), F.col("lat"))).distinct()


def polygon_edges(regions: DataFrame, code: str, geom: str, strip: float = STRIP_DEGREES) -> DataFrame:
    """Edges of every region, one row per latitude strip an edge touches, with the region's box."""
    whole = (
        regions.where(F.col(code).isNotNull() & F.col(geom).isNotNull())
        .select(F.col(code).alias("code"), F.xxhash64(geom).alias("shape"), F.col(geom).alias("geom"))
        .dropDuplicates(["code", "shape"])
        .select("code", "shape", polygon_rings(F.col("geom")).alias("rings"))
        .where(F.size("rings") > 0)
    )
    vertices = F.flatten("rings")
    xs = F.transform(vertices, lambda p: p["x"])
    boxed = whole.select(
        "code", "shape", F.array_min(xs).alias("west"), F.array_max(xs).alias("east"),
        F.explode(F.flatten(F.transform("rings", ring_edges))).alias("e"),
    )
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    strips = F.sequence(F.floor(low / strip), F.floor(high / strip))
    return boxed.select("code", "shape", "west", "east", "e.x1", "e.y1", "e.x2", "e.y2", F.explode(strips).alias("strip"))


def containing_regions(
    points: DataFrame, regions: DataFrame, code: str = "code", geom: str = "geom", strip: float = STRIP_DEGREES
) -> DataFrame:
    """(lon, lat, code) for each distinct point of ``points`` and each region that contains it."""
    spots = points.select("lon", "lat").distinct()
    spots = spots.withColumns({"strip": F.floor(F.col("lat") / strip), "column": F.floor(F.col("lon") / COLUMN_DEGREES)})
    # The edges are parsed once and read twice, for the boxes and for the crossings.
    edges = checkpoint(polygon_edges(regions, code, geom, strip))
    x, y = F.col("lon"), F.col("lat")
    # Points first find the regions whose box they may lie in, cell by cell; then each meets the edges of
    # its own strip of those regions only.  No key is as wide as a band around the world.
    boxes = edges.select("code", "shape", "west", "east", "strip").distinct()
    columns = F.sequence(F.floor(F.col("west") / COLUMN_DEGREES), F.floor(F.col("east") / COLUMN_DEGREES))
    boxes = boxes.select("*", F.explode(columns).alias("column"))
    candidates = spots.join(boxes, ["strip", "column"]).where((x >= F.col("west")) & (x <= F.col("east"))).select("lon", "lat", "strip", "code", "shape")
    met = candidates.join(edges.drop("west", "east"), ["code", "shape", "strip"])
    run, rise = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    straddles = (F.col("y1") > y) != (F.col("y2") > y)
    crossing = F.when(straddles, x < F.try_divide(run * (y - F.col("y1")), rise) + F.col("x1")).otherwise(False)
    on_edge = (
        (F.abs(run * (y - F.col("y1")) - rise * (x - F.col("x1"))) <= EDGE_TOLERANCE)
        & x.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
        & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    return (
        met.groupBy("lon", "lat", "code", "shape")
        .agg(F.count_if(crossing).alias("crossings"), F.max(on_edge).alias("edge"))
        .where((F.col("crossings") % 2 == 1) | F.col("edge"))
        .select("lon", "lat", "code")
        .distinct()
    )


def _lon_width(band: Column, band_deg: float, radius_m: float) -> Column:
    """Degrees of longitude that span the radius anywhere in a latitude band, never too few."""
    worst = F.least(F.lit(89.9), F.greatest(F.abs(band * band_deg), F.abs((band + 1) * band_deg)))
    return F.lit(radius_m / METRES_PER_DEGREE * 1.001) / F.cos(F.radians(worst))


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """(left_key, right_key, metres) for points of both sides at most ``radius_m`` apart.

    ``left`` is the side replicated into the neighbouring cells; pass the smaller one.  Equal points
    meet once, whatever the number of rows at them.
    """
    # Read for the spots and again for the keys at them, so parsed once.
    left, right = checkpoint(left.select("key", "lon", "lat")), checkpoint(right.select("key", "lon", "lat"))
    spots = near_spots(left.select("lon", "lat").distinct(), right.select("lon", "lat").distinct(), radius_m)
    a = left.select(F.col("key").alias("left_key"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = right.select(F.col("key").alias("right_key"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    return spots.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).groupBy("left_key", "right_key").agg(F.min("metres").alias("metres"))


def near_spots(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """(ax, ay, bx, by, metres) of the distinct points (lon, lat) of both sides at most ``radius_m`` apart."""
    band_deg = radius_m / METRES_PER_DEGREE * 1.001
    a = left.select(F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    a = a.withColumn("band", F.explode(F.sequence(F.floor(F.col("ay") / band_deg) - 1, F.floor(F.col("ay") / band_deg) + 1)))
    width = _lon_width(F.col("band"), band_deg, radius_m)
    # The reach in longitude is that of the more polar of the two bands that may meet.
    span = F.greatest(width, _lon_width(F.floor(F.col("ay") / band_deg), band_deg, radius_m))
    shifts = F.filter(
        F.array(F.lit(0.0), F.when(F.col("ax") - span < -180, 360.0), F.when(F.col("ax") + span > 180, -360.0)),
        lambda s: s.isNotNull(),
    )
    a = a.select("*", width.alias("w"), span.alias("span"), F.explode(shifts).alias("shift"))
    cells = F.sequence(
        F.floor((F.col("ax") + F.col("shift") - F.col("span")) / F.col("w")),
        F.floor((F.col("ax") + F.col("shift") + F.col("span")) / F.col("w")),
    )
    a = a.select("ax", "ay", "band", F.explode(cells).alias("cell"))
    b = right.select(F.col("lon").alias("bx"), F.col("lat").alias("by"))
    b = b.withColumn("band", F.floor(F.col("by") / band_deg))
    b = b.withColumn("cell", F.floor(F.col("bx") / _lon_width(F.col("band"), band_deg, radius_m)))
    metres = haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return (
        a.join(b, ["band", "cell"])
        .withColumn("metres", metres)
        .where(F.col("metres") <= radius_m)
        .select("ax", "ay", "bx", "by", "metres")
        .distinct()
    )
