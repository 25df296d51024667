"""Load gates as rows: each rule with its value, its bounds and whether it holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A measure over a table and the band it must lie in; outside it, a finding of this severity."""

    name: str
    measure: Column
    low: float | None = None
    high: float | None = None
    severity: str = "fatal"


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition; 0 of none."""
    return F.coalesce(F.try_divide(F.count_if(condition), F.count("*")), F.lit(0.0))


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, severity, value, low, high, ok): all measures in one pass over the table."""
    one = df.agg(*[r.measure.cast("double").alias(r.name) for r in rules])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.round(F.col(r.name), 6).alias("value"),
                F.lit(r.low).cast("double").alias("low"), F.lit(r.high).cast("double").alias("high"),
            )
            for r in rules
        ]
    )
    listed = one.select(F.explode(rows).alias("r")).select("r.*")
    inside = F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True))
    return listed.withColumn("ok", inside & F.col("value").isNotNull())


def enforce(findings: DataFrame) -> list[str]:
    """Raise on fatal findings; the names of the warnings otherwise.  One row per rule reaches the driver."""
    bad = findings.where("NOT ok").collect()
    fatal = [f"{r['rule']} = {r['value']}" for r in bad if r["severity"] == "fatal"]
    if fatal:
        raise ValueError("load refused: " + "; ".join(fatal))
    return [r["rule"] for r in bad]


def relative_band(now: int, before: int | None, low: float = 0.9, high: float = 1.3) -> str:
    """ok, refused, or skipped where there is nothing to compare with."""
    if not before:
        return "skipped"
    return "ok" if low <= now / before <= high else "refused"


def work_selection(keys: DataFrame, cache: DataFrame, key: str, most_attempts: int = 3, stale: Column | None = None, most_stale: int = 4) -> DataFrame:
    """Keys to look up: not cached, or not accepted and tried fewer times than allowed; one more try where the rejection is ``stale``."""
    columns = ["accepted", "attempts"]
    known = cache.select(F.col(key).alias("_k"), *columns, (F.lit(False) if stale is None else F.coalesce(stale, F.lit(False))).alias("_stale"))
    joined = keys.select(key).distinct().join(known, F.col(key) == F.col("_k"), "left")
    again = F.col("_stale") & (F.col("attempts") < most_stale)
    todo = F.col("_k").isNull() | (~F.col("accepted") & ((F.col("attempts") < most_attempts) | again))
    return joined.where(todo).select(key, F.coalesce("attempts", F.lit(0)).alias("attempts"))


def work_queue(work: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` keys of a selection, least tried first, each with how many are left for later."""
    total = work.agg(F.count("*").alias("n"))
    first = work.orderBy("attempts", key).limit(most)
    # One row beside at most ``most``.
    return first.withColumn("_one", F.lit(0)).join(total.withColumn("_one", F.lit(0)), "_one").select(key, "attempts", F.greatest(F.col("n") - most, F.lit(0)).alias("remaining"))


def diff_rules(diff: DataFrame) -> DataFrame:
    """The rules of a new generation over the counts of ``enrich.generation_diff``: coverage, removals, lost points, moves."""
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c), of), F.lit(0.0)).cast("double")
    old = F.col("kept") + F.col("removed")
    rules = [
        ("coverage", F.coalesce(F.try_divide(F.col("kept") + F.col("added"), old), F.lit(1.0)).cast("double"), 0.95, None, "fatal"),
        ("removed", share("removed", old), None, 0.10, "fatal"), ("lost_point", share("lost_point", F.col("kept")), None, 0.005, "fatal"),
        ("moved", share("moved", F.col("kept")), None, 0.20, "warning"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.round(v, 6).alias("value"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"))
            for n, v, lo, hi, s in rules
        ]
    )
    inside = F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True))
    return diff.select(F.explode(rows).alias("r")).select("r.*").withColumn("ok", inside)


def lookup_results(results: DataFrame, cache: DataFrame, key: str, least: float) -> DataFrame:
    """Cache rows after a round of look-ups: coordinates only where accepted, one more attempt, and the status."""
    good = F.coalesce((F.col("score") >= least) & F.col("kind").isin("housenumber", "street", "locality"), F.lit(False))
    status = F.when(good, "accepted").when(F.col("score").isNull(), "unresolved").otherwise("rejected_low_score")
    tried = cache.select(F.col(key).alias("_k"), F.col("attempts").alias("_n"))
    return results.join(tried, F.col(key) == F.col("_k"), "left").select(
        key, good.alias("accepted"), F.when(good, F.col("lon")).alias("lon"), F.when(good, F.col("lat")).alias("lat"),
        (F.coalesce("_n", F.lit(0)) + 1).alias("attempts"), status.alias("last_status"),
    )
