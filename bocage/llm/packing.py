"""Problem 8: filling fixed-capacity containers with texts.

Hierarchical multi-length packing.  A container's tiers are its capacity halved again and again.
Texts are routed to the smallest tier that holds them.  Each tier, the longest first, packs its own
texts into windows of its own size and fills the gaps of those windows from the shorter tiers;
windows are then laid into containers side by side, and what the containers still lack is filled
from the shorter tiers, before these pack what is left of them in the same way.  Containers of all
shards together are dealt into step groups of equal load.

Shards of texts, drawn by hash and of bounded size, are packed independently, so nothing is
packed in one place; a shard leaves at most a few part-filled containers.

Defined results: null and empty texts have no tokens and lie in no container; a text longer
than the capacity is cut into full containers and one rest, which is packed like a text;
repeated texts under different keys are different items; a capacity that is null or not
positive has no layout.  Empty tables give an empty layout.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bocage.session import bucket_count, checkpoint

TEXTS_PER_SHARD = 20_000
CONTAINERS_PER_STEP = 16
TIER_LEVELS = 5
_PACKED = "conteneur string, shard int, container int, load long, seat int, doc_id long, part int, start_token long, n_tokens long, tier int"


def tier_sizes(capacity: int, levels: int = TIER_LEVELS) -> list[int]:
    """The window sizes of a container, shortest first: its capacity and the halves of it."""
    return sorted({max(1, capacity >> k) for k in range(levels)})


def split_parts(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, part, start, size): whole items, and those above the capacity in full pieces and a rest."""
    out = []
    for item, size in enumerate(sizes):
        for part, start in enumerate(range(0, size, capacity)):
            out.append((item, part, start, min(capacity, size - start)))
    return out


class _Shelf:
    """Pieces by length; the longest that fits is found by bisection."""

    def __init__(self):
        self.stacks: dict[int, list] = {}
        self.lengths: list[int] = []

    def add(self, length: int, piece) -> None:
        if length not in self.stacks:
            self.stacks[length] = []
            insort(self.lengths, length)
        self.stacks[length].append(piece)

    def take(self, length: int):
        piece = self.stacks[length].pop()
        if not self.stacks[length]:
            del self.stacks[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return piece

    def fitting(self, gap: int, n: int = 1) -> list[int]:
        """Up to ``n`` lengths that fit, the longest first."""
        at = bisect_right(self.lengths, gap)
        return self.lengths[max(0, at - n) : at][::-1]


def _closing(shelves: list[_Shelf], tiers: list[int], k: int, gap: int, tries: int = 24) -> int | None:
    """The length to take next from the tiers up to the k-th: one that with a second closes the gap exactly, else the longest."""
    for i in range(k, -1, -1):
        options = shelves[i].fitting(gap, tries)
        if not options:
            continue
        if options[0] == gap:
            return gap
        for length in options:
            rest = gap - length
            other = shelves[bisect_left(tiers, rest)].stacks.get(rest)
            if other and (rest != length or len(other) > 1):
                return length
        return options[0]
    return None


def pack(sizes: list[int], capacity: int, tiers: list[int]) -> tuple[list[list[int]], list[int]]:
    """Containers as lists of piece indexes, and each piece's tier; no piece exceeds the capacity."""
    tiers = sorted({t for t in tiers if 0 < t < capacity} | {capacity})
    tier_of = [tiers[bisect_left(tiers, s)] for s in sizes]
    shelves = [_Shelf() for _ in tiers]
    for i, s in enumerate(sizes):
        shelves[bisect_left(tiers, s)].add(s, i)

    def filled(held: list[int], gap: int, k: int) -> int:
        """Fills a gap from the tiers up to the k-th; what stays empty."""
        while gap > 0 and k >= 0:
            length = _closing(shelves, tiers, k, gap)
            if length is None:
                break
            held.append(shelves[bisect_left(tiers, length)].take(length))
            gap -= length
        return gap

    containers = []
    for k in range(len(tiers) - 1, -1, -1):
        windows, own = _Shelf(), shelves[k]
        while own.lengths:
            longest = own.lengths[-1]
            window = [own.take(longest)]
            empty = filled(window, tiers[k] - longest, k)
            windows.add(tiers[k] - empty, window)
        while windows.lengths:
            longest = windows.lengths[-1]
            container, gap = list(windows.take(longest)), capacity - longest
            while fits := windows.fitting(gap):
                container += windows.take(fits[0])
                gap -= fits[0]
            filled(container, gap, k - 1)
            containers.append(container)
    return containers, tier_of


def _shard_layout(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id"], kind="stable").reset_index(drop=True)
    name, shard, capacity = pdf.at[0, "conteneur"], pdf.at[0, "shard"], int(pdf.at[0, "capacity"])
    pieces = split_parts([int(n) for n in pdf["n_tokens"]], capacity)
    sizes = [p[3] for p in pieces]
    containers, tiers = pack(sizes, capacity, tier_sizes(capacity))
    ids, rows, seats = pdf["doc_id"].tolist(), [], Counter()
    for c, members in enumerate(containers):
        load = sum(sizes[i] for i in members)
        for i in members:
            item, part, start, size = pieces[i]
            rows.append((name, shard, c, load, seats[load], ids[item], part, start, size, tiers[i]))
        seats[load] += 1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PACKED.split(", ")])


def with_steps(packed: DataFrame, per_step: int = CONTAINERS_PER_STEP) -> DataFrame:
    """Adds ``step_group``: all containers of a kind, of every shard, dealt by load in snake order, so that groups weigh alike.

    Places come from counts by load and shard, so no task orders the containers themselves.
    """
    counts = packed.groupBy("conteneur", "load", "shard").agg((F.max("seat") + 1).cast("long").alias("n"))
    loads = counts.groupBy("conteneur", "load").agg(F.sum("n").alias("n_load"))
    # At most one row for each load, hence no more than the capacity.
    heavier = Window.partitionBy("conteneur").orderBy(F.desc("load"))
    loads = loads.select(
        "conteneur", "load", (F.sum("n_load").over(heavier) - F.col("n_load")).alias("before"),
        F.ceil(F.sum("n_load").over(Window.partitionBy("conteneur")) / per_step).alias("groups"),
    )
    earlier = Window.partitionBy("conteneur", "load").orderBy("shard")
    spots = counts.withColumn("own", F.sum("n").over(earlier) - F.col("n")).join(loads, ["conteneur", "load"])
    spots = spots.select("conteneur", "load", "shard", (F.col("before") + F.col("own")).alias("first"), "groups")
    place = F.col("first") + F.col("seat")
    seat = F.pmod(place, F.col("groups"))
    group = F.when(F.floor(place / F.col("groups")) % 2 == 0, seat).otherwise(F.col("groups") - 1 - seat)
    return packed.join(spots, ["conteneur", "load", "shard"]).withColumn("step_group", group)


def layouts(lengths: DataFrame, containers: DataFrame, texts_per_shard: int = TEXTS_PER_SHARD) -> DataFrame:
    """One layout of all texts for each container kind; ``lengths`` has doc_id and n_tokens."""
    kinds = containers.where("capacite_tokens > 0").select("conteneur", F.col("capacite_tokens").cast("long").alias("capacity")).distinct()
    real = lengths.where("doc_id IS NOT NULL AND n_tokens > 0").select("doc_id", "n_tokens")
    shards = bucket_count(real.count(), texts_per_shard)
    # Every kind is offered to every shard, so the join has an even key whatever the number of kinds.
    offers = kinds.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = real.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).join(offers, "shard")
    packed = checkpoint(spread.groupBy("conteneur", "shard").applyInPandas(_shard_layout, _PACKED))
    return with_steps(packed).select(
        "conteneur", F.concat_ws("-", "shard", "container").alias("container_id"), "step_group", "doc_id", "part", "start_token", "n_tokens", "tier"
    )


def step_balance(layout: DataFrame) -> DataFrame:
    """Per container kind: step groups, and the tokens of the lightest and the heaviest."""
    per = layout.groupBy("conteneur", "step_group").agg(F.sum("n_tokens").alias("n"), F.countDistinct("container_id").alias("c"))
    return per.groupBy("conteneur").agg(
        F.count("*").alias("n_groups"), F.min("n").alias("least_tokens"), F.max("n").alias("most_tokens"),
        F.min("c").alias("least_containers"), F.max("c").alias("most_containers"),
    )


def tier_usage(layout: DataFrame) -> DataFrame:
    """Per container kind and tier: its texts and tokens, and the containers they lie in."""
    return layout.groupBy("conteneur", "tier").agg(
        F.countDistinct("doc_id").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("container_id").alias("n_containers")
    )


def usage(layout: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: containers, texts, tokens, and the share of space left unused."""
    kinds = containers.select("conteneur", F.col("capacite_tokens").cast("long").alias("capacity")).distinct()
    per = layout.groupBy("conteneur").agg(
        F.countDistinct("container_id").alias("n_containers"), F.countDistinct("doc_id").alias("n_texts"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    space = F.col("n_containers") * F.col("capacity")
    return per.join(kinds, "conteneur").select(
        "conteneur", "capacity", "n_containers", "n_texts", "n_tokens", F.round(1 - F.col("n_tokens") / space, 6).alias("unused_share")
    )
