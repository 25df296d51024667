"""Problem 3: percentiles of very large numeric columns.

Distributed multi-select.  The values of a group are kept as sorted runs of bounded length,
one or more per day.  In each round every run proposes, from what it still holds between the
bounds of each wanted rank, the value at the place of the rank or, every other round, the median;
the weighted median of the proposals becomes the pivot; the runs count below, equal and above it
three ways; the range that cannot hold the rank is discarded, and the round repeats per group until
every rank is found.  Each round of medians drops at least an eighth of what is left, so the number
of rounds is logarithmic.  All groups go the same way; one that fits in one run is done after one round.

The result is exact, so its error is bounded by rounding alone.  Counts and proposals of
separate days add up: the runs of any set of days can be kept (``day_runs``) and selected
from together later (``percentiles``).  ``day_sketches`` is a smaller summary to combine, with
a relative error of at most ``RELATIVE_ERROR`` per value.

Defined results: null, NaN, infinite and non-positive values take no part; a row delivered
again, equal in all columns but the load time, counts once, on the day it first came; null
groups take no part; groups without values have no row; ties are values like any other.
Empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.session import checkpoint

RUN_VALUES = 32_768
MOST_ROUNDS = 200
#: Proposals that one task combines at a time.
LOT = 1024
QUANTILES = (0.25, 0.5, 0.75)
RELATIVE_ERROR = 0.005
_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)


def clean_values(df: DataFrame, group: str, value: str, loaded: str) -> DataFrame:
    """(g, day, v, h): usable values, each delivered row once, on its first day, with its hash.

    Rows are told apart by two 64-bit hashes of all other columns, so only the value, the
    group and the hashes are shuffled.
    """
    others = [c for c in df.columns if c != loaded]
    # Null marks keep (null, x) and (x, null) apart.
    parts = [p for c in others for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    v = F.col(value).cast("double")
    usable = df.where(F.col(group).isNotNull() & (v > 0) & (v < float("inf")) & ~F.isnan(v))
    once = usable.select(
        F.col(group).alias("g"), v.alias("v"), F.to_date(loaded).alias("day"), F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit(1), *parts).alias("h2"),
    )
    return once.groupBy("g", "v", "h1", "h2").agg(F.min("day").alias("day")).select("g", "day", "v", F.col("h1").alias("h"))


def day_runs(values: DataFrame, run_values: int = RUN_VALUES, by_day: bool = True) -> DataFrame:
    """(g, day, piece, run): sorted runs of a bounded number of values, the mergeable form of a day.

    Pieces are drawn by the hash of the row, so a task run again draws the same.

    ``by_day`` false puts all days of a group together, for fewer and longer runs.
    """
    keys = ["g", "day"] if by_day else ["g"]
    sizes = values.groupBy(*keys).agg(F.ceil(F.count("*") / run_values).alias("pieces"))
    whole = sizes.where("pieces > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "pieces")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # Groups of more than one run are at most one in run_values rows: a small side by construction.
    cut = values.join(whole, same, "left")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.col("h"), F.col("pieces"))).otherwise(0)
    runs = cut.withColumn("piece", piece).groupBy(*keys, "piece").agg(
        F.array_sort(F.collect_list("v")).alias("run"), *([] if by_day else [F.min("day").alias("day")])
    )
    return runs.select("g", "day", F.col("piece").cast("long").alias("piece"), "run")


def _below(run: Column, x: Column, inclusive: bool) -> Column:
    """How many values of a sorted run lie below ``x``, or at it too: a binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(run).alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(run) + F.lit(1.0))).cast("int") + 1)

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        v = F.element_at(run, F.least(middle + 1, F.size(run)))
        low = (v <= x) if inclusive else (v < x)
        done = s["lo"] >= s["hi"]
        return F.struct(
            F.when(done, s["lo"]).when(low, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(done, s["hi"]).when(low, s["hi"]).otherwise(middle).alias("hi"),
        )

    return F.aggregate(steps, start, step)["lo"]


def _weighted_median(pairs: Column) -> Column:
    """Of (m, w) pairs the m that half the weight lies at or below."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0).cast("long"), lambda t, p: t + p["w"]) / 2
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("m"))

    def step(s: Column, p: Column) -> Column:
        seen = s["seen"] + p["w"]
        return F.struct(seen.alias("seen"), F.when(s["m"].isNotNull(), s["m"]).when(seen >= half, p["m"]).alias("m"))

    return F.aggregate(ordered, start, step)["m"]


def _opened(runs: DataFrame, quantiles: tuple) -> DataFrame:
    """The state before the first round: per group its size and, for each quantile, a rank, an open range and no value."""
    sized = runs.groupBy("g").agg(F.sum(F.size("run")).cast("long").alias("n"))
    out = {}
    for i, q in enumerate(quantiles):
        out |= {
            f"lo{i}": F.lit(-math.inf), f"hi{i}": F.lit(math.inf), f"left{i}": (F.floor(F.lit(q) * (F.col("n") - 1)) + 1).cast("long"),
            f"total{i}": F.col("n"), f"val{i}": F.lit(None).cast("double"), f"nxt{i}": F.lit(None).cast("double"),
        }
    return sized.withColumns(out)


def _pivots(runs: DataFrame, state: DataFrame, k: int, medians: bool) -> DataFrame:
    """(g, pivot0, ...): each run proposes a value it still holds, and the weighted median of the proposals is the pivot.

    A run proposes its value at the place the wanted rank has among all that is left, in every
    other round its median.  Proposals are combined in two steps, so no task holds all of a group.
    """
    held = runs.join(state.select("g", *[f"{c}{i}" for i in range(k) for c in ("lo", "hi", "left", "total", "val")]), "g")
    run = F.col("run")
    held = held.withColumns({f"i{i}": _below(run, F.col(f"lo{i}"), True) for i in range(k)} | {f"j{i}": _below(run, F.col(f"hi{i}"), False) for i in range(k)})
    proposals = []
    for i in range(k):
        held_n = F.col(f"j{i}") - F.col(f"i{i}")
        share = F.lit(0.5) if medians else (F.col(f"left{i}") - 0.5) / F.col(f"total{i}")
        at = F.col(f"i{i}") + F.least(held_n - 1, F.floor(share * held_n)).cast("int") + 1
        m = F.when(F.col(f"val{i}").isNull() & (held_n > 0), F.element_at(run, F.greatest(at, F.lit(1))))
        proposals.append(F.when(m.isNotNull(), F.struct(m.alias("m"), held_n.cast("long").alias("w"))).alias(f"p{i}"))
    made = held.select("g", "lot", *proposals)
    lots = made.groupBy("g", "lot").agg(*[F.collect_list(f"p{i}").alias(f"p{i}") for i in range(k)])
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, p: t + p["w"])
    some = lambda c: F.when(F.size(c) > 0, F.struct(_weighted_median(F.col(c)).alias("m"), weight(F.col(c)).alias("w")))
    merged = lots.select("g", *[some(f"p{i}").alias(f"p{i}") for i in range(k)]).groupBy("g").agg(*[F.collect_list(f"p{i}").alias(f"p{i}") for i in range(k)])
    return merged.select("g", *[_weighted_median(F.col(f"p{i}")).alias(f"pivot{i}") for i in range(k)])


def _counted(runs: DataFrame, state: DataFrame, pivots: DataFrame, quantiles: tuple) -> DataFrame:
    """The state after counting each range three ways around its pivot and discarding what cannot hold the rank."""
    run, aggregates, k = F.col("run"), [], len(quantiles)
    around = runs.join(pivots, "g").withColumns(
        {f"b{i}": _below(run, F.col(f"pivot{i}"), False) for i in range(k)} | {f"e{i}": _below(run, F.col(f"pivot{i}"), True) for i in range(k)}
    )
    for i in range(k):
        after = F.when(F.col(f"e{i}") < F.size(run), F.element_at(run, F.least(F.col(f"e{i}") + 1, F.size(run))))
        aggregates += [F.sum(f"b{i}").alias(f"b{i}"), F.sum(f"e{i}").alias(f"e{i}"), F.min(after).alias(f"after{i}")]
    # Ranks in the whole group: what lies below the range is known from the rank the range began with.
    sums = around.groupBy("g").agg(*aggregates)
    out = state.join(pivots, "g").join(sums, "g")
    new = {}
    for i in range(k):
        pivot, found = F.col(f"pivot{i}"), F.col(f"val{i}").isNotNull()
        rank = F.floor(F.lit(quantiles[i]) * (F.col("n") - 1)) + 1
        offset = rank - F.col(f"left{i}")  # values at or below the range
        below, upto, left = F.col(f"b{i}") - offset, F.col(f"e{i}") - offset, F.col(f"left{i}")
        hit, lower = ~found & (left > below) & (left <= upto), ~found & (left <= below)
        upper = ~found & (left > upto)
        new |= {
            f"val{i}": F.when(hit, pivot).otherwise(F.col(f"val{i}")),
            f"nxt{i}": F.when(hit, F.when(left < upto, pivot).otherwise(F.col(f"after{i}"))).otherwise(F.col(f"nxt{i}")),
            f"hi{i}": F.when(lower, pivot).otherwise(F.col(f"hi{i}")), f"lo{i}": F.when(upper, pivot).otherwise(F.col(f"lo{i}")),
            f"total{i}": F.when(lower, below).when(upper, F.col(f"total{i}") - upto).otherwise(F.col(f"total{i}")).cast("long"),
            f"left{i}": F.when(upper, left - upto).otherwise(left).cast("long"),
        }
    return out.withColumns(new).select(state.columns)


def multi_select(runs: DataFrame, quantiles: tuple = QUANTILES) -> DataFrame:
    """(g, n, val0, nxt0, ...): for each group and quantile the value at its rank and the one after.

    The state of the groups is a table joined with the runs, never a driver variable; the driver
    learns only whether any group is left.  Groups leave the rounds as soon as all their ranks are found.
    """
    k = len(quantiles)
    open_ = F.lit(False)
    for i in range(k):
        open_ = open_ | F.col(f"val{i}").isNull()
    runs = runs.withColumn("lot", F.floor(F.col("piece") / LOT))
    state, done = _opened(runs, quantiles), []
    for turn in range(MOST_ROUNDS):
        # Every other round proposes plain medians, which drops at least an eighth of what is left, whatever the runs hold.
        state = checkpoint(_counted(runs, state, _pivots(runs, state, k, turn % 2 == 1), quantiles))
        done.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
    else:
        raise RuntimeError("multi-select did not end")
    return reduce(DataFrame.unionByName, done)


def merged(runs: DataFrame, run_values: int = RUN_VALUES) -> DataFrame:
    """Runs of many days as fewer runs near the full length, so a round reads few and long ones."""
    sizes = runs.groupBy("g").agg(F.ceil(F.sum(F.size("run")) / run_values).alias("pieces"))
    lot = F.pmod(F.xxhash64("day", "piece"), F.col("pieces")).alias("piece")
    dealt = runs.join(sizes, "g").select("g", "day", lot, "run")
    return dealt.groupBy("g", "piece").agg(F.min("day").alias("day"), F.array_sort(F.flatten(F.collect_list("run"))).alias("run"))


def percentiles(runs: DataFrame, quantiles: tuple = QUANTILES) -> DataFrame:
    """(g, n, p25, p50, ...): exact percentiles with linear interpolation, by multi-select over runs of any days."""
    found = multi_select(runs, quantiles)
    out = []
    for i, q in enumerate(quantiles):
        at = F.lit(q) * (F.col("n") - 1)
        a, b = F.col(f"val{i}"), F.coalesce(F.col(f"nxt{i}"), F.col(f"val{i}"))
        out.append(_between(a, b, at - F.floor(at)).alias(f"p{round(q * 100):02d}"))
    return found.select("g", "n", *out)


def _between(a: Column, b: Column, share: Column) -> Column:
    """The value at a share of the way from ``a`` to ``b``: a (1 - share) + b share with a fused multiply-add, to the last bit as SQL's quantile_cont."""
    # Reflection returns a string, which keeps every bit of a double.
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, F.lit(1.0) - share, b * share).cast("double")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded as the SQL rounds: scaled in binary, half away from zero, scaled back; F.round goes by the decimal digits, where other values are ties."""
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < math.inf, F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def kept_runs(df: DataFrame, group: str, value: str, loaded: str, run_values: int = RUN_VALUES, by_day: bool = False) -> DataFrame:
    """Runs of a table, in reliable storage for the rounds that read them again."""
    return checkpoint(day_runs(clean_values(df, group, value, loaded), run_values, by_day))


def day_sketches(values: DataFrame) -> DataFrame:
    """(g, day, bin, n): counts of values by logarithmic bin, which simply add up over days."""
    edge = F.ceil(F.log("v") / math.log(_GAMMA)).cast("int")
    return values.groupBy("g", "day", edge.alias("bin")).agg(F.count("*").alias("n"))


def from_sketches(sketches: DataFrame, quantiles: tuple = QUANTILES) -> DataFrame:
    """(g, n, p25, ...) from the sketches of any days: each within ``RELATIVE_ERROR`` of a value of its rank."""
    from pyspark.sql import Window

    bins = sketches.groupBy("g", "bin").agg(F.sum("n").alias("n"))
    # A group has a few thousand bins at most: the range of doubles over the bin width.
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    ranked = bins.select("g", "bin", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    middle = F.lit(2.0 / (_GAMMA + 1)) * F.pow(F.lit(_GAMMA), F.col("bin"))
    out = [
        F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), middle)).alias(f"p{round(q * 100):02d}") for q in quantiles
    ]
    return ranked.groupBy("g").agg(F.max("total").alias("n"), *out)
