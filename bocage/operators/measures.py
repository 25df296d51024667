"""Aggregates: count cubes, percentiles with filters, month coverage, weighted means, rates, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_cube(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by every dimension, null groups kept: the base that later totals add up from."""
    return df.groupBy(*dimensions).agg(F.count("*").alias("n"))


def cube_total(cube: DataFrame, **wanted) -> DataFrame:
    """One total from a cube under optional equalities; nothing found is 0."""
    for column, value in wanted.items():
        if value is not None:
            cube = cube.where(F.col(column) == value)
    return cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def cube_totals(cube: DataFrame, scopes: dict[str, dict]) -> DataFrame:
    """(scope, n): several totals in one pass over the cube."""
    sums = []
    for name, wanted in scopes.items():
        fits = F.lit(True)
        for column, value in wanted.items():
            fits = fits & F.coalesce(F.col(column) == value, F.lit(False))
        sums.append(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias(name))
    rows = F.array(*[F.struct(F.lit(name).alias("scope"), F.col(f"`{name}`").alias("n")) for name in scopes])
    return cube.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def percentile_if(value: Column, q: float, condition: Column | None = None) -> Column:
    """Exact percentile with linear interpolation over the values that meet the condition."""
    return F.percentile(value if condition is None else F.when(condition, value), q)


ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per group (of one row without ``keys``) percentiles with linear interpolation, exact though no task holds a group's values.

    A first pass bounds each rank by approximate percentiles, whose error is at most a share of
    1 / ``ACCURACY`` of the values; a second counts what lies below the bounds and keeps only what
    lies between.  ``wanted`` gives for each name the value, null where it takes no part, and the quantile.
    """
    by = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    rows = df.select(*by, *[v.cast("double").alias(n) for n, (v, _) in wanted.items()])
    names = list(keys) or ["_all"]
    margin = 2.0 / ACCURACY
    bounds = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in names]).agg(
        *[F.percentile_approx(n, [max(0.0, q - margin), min(1.0, q + margin)], ACCURACY).alias(f"{n}_at") for n, (_, q) in wanted.items()],
        *[F.count(n).alias(f"{n}_n") for n in wanted],
    )
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    near = rows.join(bounds, same).select(*names, *[F.col(c) for n in wanted for c in (n, f"{n}_at", f"{n}_n")])
    held = near.groupBy(*names).agg(
        *[F.count_if(F.col(n) < F.col(f"{n}_at")[0]).alias(f"{n}_below") for n in wanted],
        *[F.array_sort(F.collect_list(F.when(F.col(n).between(F.col(f"{n}_at")[0], F.col(f"{n}_at")[1]), F.col(n)))).alias(f"{n}_held") for n in wanted],
        # In a small group the bounds may miss the rank by one place.
        *[F.max(F.when(F.col(n) < F.col(f"{n}_at")[0], F.col(n))).alias(f"{n}_before") for n in wanted],
        *[F.min(F.when(F.col(n) > F.col(f"{n}_at")[1], F.col(n))).alias(f"{n}_after") for n in wanted],
        *[F.max(f"{n}_n").alias(f"{n}_n") for n in wanted],
    )

    def value(n: str, rank: Column) -> Column:
        place = (rank - F.col(f"{n}_below") + 1).cast("int")
        inside = F.try_element_at(f"{n}_held", F.greatest(place, F.lit(1)))
        return F.when(place < 1, F.col(f"{n}_before")).when(place > F.size(f"{n}_held"), F.col(f"{n}_after")).otherwise(inside)

    out = []
    for n, (_, q) in wanted.items():
        at = F.lit(q) * (F.col(f"{n}_n") - 1)
        low, high = value(n, F.floor(at)), value(n, F.ceil(at))
        out.append(F.when(F.col(f"{n}_n") > 0, low + (high - low) * (at - F.floor(at))).alias(n))
    return held.select(*keys, *out)


def first_and_set(
    df: DataFrame, key: str, order: Column, scalars: Sequence[str], code: str, label: str
) -> DataFrame:
    """One row per key: scalars of its first row, and its codes with the last label of each, sorted and aligned."""
    firsts = df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in scalars])
    labels = df.where(F.col(code).isNotNull()).groupBy(key, code).agg(F.max_by(label, order).alias(label))
    sets = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(code, label))).alias("_set"))
    return firsts.join(sets, key, "left").withColumns(
        {"codes": F.transform("_set", lambda s: s[code]), "labels": F.transform("_set", lambda s: s[label])}
    ).drop("_set")


def month_coverage(df: DataFrame, keys: Sequence[str], year: Column, month: Column, *sums: str) -> DataFrame:
    """Yearly sums, the months that are there (as a bit mask and a count), and how often a month came again."""
    rows = df.withColumns({"_y": year, "_m": month})
    bit = F.call_function("shiftleft", F.lit(1), (F.col("_m") - 1).cast("int"))
    return rows.groupBy(*keys, F.col("_y").alias("year")).agg(
        *[F.sum(c).alias(c) for c in sums], F.bit_or(bit).alias("month_mask"),
        F.bit_count(F.bit_or(bit)).alias("n_months"),
        (F.count("_m") - F.countDistinct("_m")).alias("n_repeats"),
    )


def published_month(df: DataFrame, month: Column, share: float = 0.5) -> DataFrame:
    """The latest month that has at least this share of the rows of the fullest."""
    months = df.where(month.isNotNull()).groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    full = months.withColumn("most", F.max("n").over(Window.partitionBy(F.lit(0))))
    return full.where(F.col("n") >= share * F.col("most")).agg(F.max("month").alias("month"))


def rolling_year(df: DataFrame, day: str, last: DataFrame) -> DataFrame:
    """Rows of the twelve months that end with the month of a one-row table (first days as dates)."""
    months = F.explode(F.sequence(F.add_months("month", -11), F.col("month"), F.expr("INTERVAL 1 MONTH"))).alias("_month")
    return df.join(last.where("month IS NOT NULL").select(months), F.trunc(F.col(day), "month") == F.col("_month"), "left_semi")


def latest_pivot(df: DataFrame, key: Sequence[str], period: str, measure: str, value: str, order: str, measures: Sequence[str]) -> DataFrame:
    """The values of each key's latest period, measures as columns; of repeated ones the last."""
    newest = df.groupBy(*key).agg(F.max(period).alias("_period"))
    rows = df.join(newest, list(key)).where(F.col(period) == F.col("_period"))
    return rows.groupBy(*key, F.col("_period").alias(period)).agg(
        *[F.max_by(value, F.when(F.col(measure) == m, F.col(order))).alias(m) for m in measures]
    )


def weighted_profile(df: DataFrame, keys: Sequence[str], population: str, income: str, parts: Sequence[str]) -> DataFrame:
    """Sums, shares of the population, mean income weighted over the rows that have one, and how much they cover."""
    pop = F.coalesce(F.col(population), F.lit(0))
    covered = F.when(F.col(income).isNotNull(), pop).otherwise(0)
    total = F.sum(pop)
    return df.groupBy(*keys).agg(
        total.alias("population"),
        *[F.round(F.try_divide(F.sum(F.coalesce(F.col(p), F.lit(0))), total), 4).alias(f"share_{p}") for p in parts],
        F.round(F.try_divide(F.sum(covered * F.coalesce(F.col(income), F.lit(0))), F.sum(covered)), 2).alias("mean_income"),
        F.round(F.try_divide(F.sum(covered) * 100.0, total), 1).alias("covered_pct"),
        F.count_if(F.col(income).isNull()).alias("n_missing"),
    )


def rate_per(counts: DataFrame, population: DataFrame, key: str, per: int = 100_000) -> DataFrame:
    """Count, population and rate by key, and the gap of the rate from that of all keys together, in per cent."""
    from bocage.functions.numbers import round_half_up

    joined = counts.join(population, key)
    everywhere = Window.partitionBy(F.lit(0))
    rate = F.when(F.col("population") > 0, round_half_up(F.col("n") * float(per) / F.col("population"), 2)).otherwise(0.0)
    national = F.sum("n").over(everywhere) * float(per) / F.sum("population").over(everywhere)
    out = joined.withColumns({"rate": rate, "national": round_half_up(national, 2)})
    gap = F.when(F.col("national") > 0, round_half_up((F.col("rate") - F.col("national")) / F.col("national") * 100, 2)).otherwise(0.0)
    return out.withColumn("gap_pct", gap)


def freshness(runs: DataFrame, source: str, at: str, status: str, changed: Column, now: Column) -> DataFrame:
    """Per source: last attempt, last served run, last real change, and their ages in whole days."""
    from bocage.functions.numbers import age_days

    served = F.col(status).isin("success", "partial")
    return runs.groupBy(source).agg(
        F.max(at).alias("last_attempt"), F.max_by(status, at).alias("last_status"),
        F.max(F.when(served, F.col(at))).alias("last_served"), F.max(F.when(served & changed, F.col(at))).alias("last_change"),
    ).withColumns({"served_days": age_days(now, F.col("last_served")), "change_days": age_days(now, F.col("last_change"))})
