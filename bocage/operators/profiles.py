"""Composites over places: area profiles, rosters, ranked candidates, resolution cascades, sections of a study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bocage.operators import measures, proximity, query
from bocage.session import checkpoint


def one_row_each(df: DataFrame, key: str, wanted: DataFrame, order: Sequence[str]) -> DataFrame:
    """Exact look-up: for each wanted key (column ``key``) its greatest row and how many distinct rows there are; unknown keys keep a row with none."""
    rows = df.join(wanted.select(key).distinct(), key, "left_semi").distinct()
    body = [c for c in df.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("_r"), F.count("*").alias("n_rows"))
    out = wanted.select(key).distinct().join(best, key, "left")
    return out.select(key, *[F.col("_r")[c].alias(c) for c in body], F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) > 1).alias("several"))


def profile(areas: DataFrame, scope: str) -> DataFrame:
    """One row: the weighted profile of a set of areas (population, income, young, old), with their number."""
    return measures.weighted_profile(areas.withColumn("scope", F.lit(scope)), ["scope"], "population", "income", ["young", "old"]).join(
        areas.agg(F.count("*").alias("n_areas"), F.lit(scope).alias("scope")), "scope"
    )


def area_profile(
    areas: DataFrame, regions: DataFrame, code: str | None = None, point: tuple[float, float] | None = None, radius_m: float | None = None
) -> DataFrame:
    """The profile asked for by a code or a point, of the area alone or, with a radius, of the basin of areas whose centres lie in it.

    ``areas`` has code, lon, lat and the measures, ``regions`` code and geom.  A code is that of an
    area (nine characters), a commune (five) or a département (two or three); exactly one of code
    and point must be given.  No area found gives no row.
    """
    kind = query.exactly_one(code=code, point=point)
    if kind == "code":
        own = areas.where(F.col("code") == code) if len(code) == 9 else areas.where(F.col("code").startswith(code))
    else:
        spot = areas.sparkSession.createDataFrame([point], "lon double, lat double")
        own = areas.join(proximity.containing_regions(spot, regions, "code", "geom").select("code"), "code", "left_semi")
    if radius_m is None:
        return profile(own, "area").where("n_areas > 0")
    if kind == "point":
        return profile(query.in_radius(areas, point[0], point[1], radius_m), "basin").where("n_areas > 0")
    # The centre of the code's own areas is one row, reached by a cell of the grid like any other point.
    middle = own.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).where("lon IS NOT NULL")
    near = proximity.near_spots(middle, areas.select("lon", "lat").distinct(), radius_m)
    inside = areas.join(near.select(F.col("bx").alias("lon"), F.col("by").alias("lat")), ["lon", "lat"], "left_semi")
    return profile(inside, "basin").where("n_areas > 0")


def population_by(areas: DataFrame, code: str) -> DataFrame:
    """Population at the granularity a code's length asks for: area, commune, département, or the whole country for ``FR``."""
    level = {9: "area", 5: "commune"}.get(len(code), "department")
    chosen = areas if code == "FR" else areas.where(F.col("code").startswith(code))
    total = chosen.agg(F.sum("population").alias("population"), F.count("*").alias("n_areas"))
    return total.select(F.lit(code).alias("code"), F.lit("country" if code == "FR" else level).alias("level"), "population", "n_areas")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Candidates of each group by several criteria in turn, the first ``k`` with their rank."""
    return query.top_per_group(df, group, order, k)


def resolved(candidates: DataFrame, key: str, candidate: str, owner: str, score: str, name: str, address: str, least_address: float = 0.6, least_name: float = 0.2) -> DataFrame:
    """(key, status, candidate): the gates of a resolution in turn.

    Only candidates at the address count; among them those whose name is not foreign; what is left
    of one owner is resolved to its best-scored, of several it is ambiguous unless one leads by
    score; nothing left is ``none``.
    """
    # Read for the lead of each key and again for ties with it.
    gated = checkpoint(candidates.select(key, candidate, owner, score, name, address)).withColumn("_ok", (F.col(address) >= least_address) & (F.col(name) >= least_name))
    best = F.max(F.when(F.col("_ok"), F.struct(score, name, candidate)))
    lead = gated.groupBy(key).agg(
        best.alias("_b"), F.countDistinct(F.when(F.col("_ok"), F.col(owner))).alias("_owners"), F.max(F.when(F.col("_ok"), F.col(score))).alias("_top")
    )
    tied = gated.join(lead.select(key, "_top"), key).where(F.col("_ok") & (F.col(score) == F.col("_top"))).groupBy(key).agg(F.countDistinct(owner).alias("_tied"))
    out = lead.join(tied, key, "left")
    status = F.when(F.col("_b").isNull(), "none").when(F.col("_owners") == 1, "resolved").when(F.col("_tied") == 1, "leading").otherwise("ambiguous")
    return out.select(key, status.alias("status"), F.when(status.isin("resolved", "leading"), F.col("_b")[candidate]).alias(candidate))


def successions(sites: DataFrame, place: Sequence[str], key: str, owner: str, active: str, opened: str, closed: str) -> DataFrame:
    """Closed sites with the active ones of another owner that opened at the same place no earlier than they closed; the next one first."""
    gone = sites.where(~F.col(active) & F.col(closed).isNotNull()).select(*place, F.col(key).alias("before"), F.col(owner).alias("_o"), closed)
    here = sites.where(F.col(active)).select(*place, F.col(key).alias("after"), F.col(owner).alias("_p"), opened)
    met = gone.join(here, list(place)).where((F.col("_o") != F.col("_p")) & (F.col(opened) >= F.col(closed)))
    return query.top_per_group(met, ["before"], [F.col(opened), F.col("after")], 1).drop("rank", "_o", "_p")


def name_comparison(df: DataFrame, key: str, own: Column, others: DataFrame, other: Column) -> DataFrame:
    """(key, verdict): whether any other name for the key equals its own, none does, or none is known."""
    known = others.where(other.isNotNull()).select(F.col(key), other.alias("_n")).distinct()
    mine = df.select(F.col(key), own.alias("_own")).distinct()
    hit = F.max(F.when(F.col("_n").isNotNull(), F.coalesce(F.col("_n") == F.col("_own"), F.lit(False))))
    return mine.join(known, key, "left").groupBy(key).agg(
        F.when(hit.isNull(), "absent").when(hit, "exact_match").otherwise("divergent").alias("verdict")
    )


def section(df: DataFrame, name: str, limit: int) -> DataFrame:
    """One row of a study: how many rows a section has, whether a list of them would be cut, and its status."""
    n = df.agg(F.count("*").alias("n"))
    return n.select(F.lit(name).alias("section"), "n", (F.col("n") > limit).alias("truncated"), F.when(F.col("n") == 0, "empty").otherwise("ok").alias("status"))
