"""Problem 9: mixing sources to target weights.

A low-discrepancy sequence decides which source fills each slot of the schedule: the points
of the golden-ratio sequence are mapped through the cumulative weights of the sources.  The
slots of a source are ranked, and the j-th takes the j-th block of its texts, shuffled and
cut into blocks of equal token counts; past the last block the source starts over.

The total is the largest at which every source that has text can meet its target within its
repetitions; sources without text keep their row in the report, with a share of zero, and the
others share their part in proportion.

All ranks and running sums go through bounded buckets first, so no source, however large, is
summed or ranked in one task.

Defined results: texts of null or untargeted sources, null keys and texts without tokens take
no part; a null or non-positive target counts as zero, null repetitions as one; repeated
target rows count once; empty tables give an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bocage.session import bucket_count, checkpoint

BLOCK_TOKENS = 1024
ROWS_PER_BUCKET = 10_000
#: Cells of the unit interval, by which points find the stretch of their source.
CELLS = 4096
GOLDEN = (math.sqrt(5) - 1) / 2
_HASHES = 1 << 40


def source_plan(stock: DataFrame, targets: DataFrame, block_tokens: int) -> DataFrame:
    """One row per source with text and target: blocks and their tokens, repetitions, its stretch of the unit interval, and the slots of all.

    The total is the largest that all sources can meet.  ``stock`` has source and tokens; the table
    has a row a source, so its sums are taken in one place, and nothing of it reaches the driver.
    """
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max(F.coalesce("part_cible", F.lit(0.0))).cast("double").alias("w"), F.max(F.coalesce("repetitions_max", F.lit(1))).cast("long").alias("repeat")
    )
    live = wanted.where("w > 0 AND repeat > 0").join(stock.where("tokens > 0"), "source")
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("source")
    blocks = F.greatest(F.lit(1), F.round(F.col("tokens") / block_tokens)).cast("long")
    live = live.withColumns({"weight": F.col("w") / F.sum("w").over(every), "blocks": blocks, "block": F.col("tokens") / blocks})
    live = live.withColumn("total", F.min(F.col("repeat") * F.col("tokens") / F.col("weight")).over(every))
    live = live.withColumn("turns", F.col("total") * F.col("weight") / F.col("block"))
    live = live.withColumns({"all_turns": F.sum("turns").over(every), "upto": F.sum("turns").over(before), "last": F.max("source").over(every)})
    high = F.when(F.col("source") == F.col("last"), 1.0).otherwise(F.col("upto") / F.col("all_turns"))
    return live.select(
        "source", "repeat", "blocks", "block", F.floor("all_turns").alias("slots"), ((F.col("upto") - F.col("turns")) / F.col("all_turns")).alias("low"), high.alias("high")
    )


def _stocked_blocks(lengths: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, n_tokens, block): shuffled texts cut into blocks of equal tokens, a text in the one it starts in."""
    order = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(_HASHES))
    buckets = bucket_count(lengths.count(), ROWS_PER_BUCKET)
    width = -(-_HASHES // buckets)
    rows = lengths.withColumn("place", order).withColumn("bucket", F.floor(F.col("place") / width))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(
        "source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id")
    placed = rows.join(before, ["source", "bucket"]).withColumn(
        "start", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")
    )
    sized = placed.join(sources.select("source", "block", "blocks"), "source")
    return sized.select("source", "doc_id", "n_tokens", F.least(F.floor(F.col("start") / F.col("block")), F.col("blocks") - 1).cast("long").alias("block"))


def _schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, source, turn): the source of each slot, and how many of its slots come before.

    Points meet the stretches of the sources cell by cell of the unit interval, an equi-join whatever their number.
    """
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    stretches = sources.select("source", "low", "high", cells)
    met = points.join(stretches, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    chunked = met.select("slot", "source", F.floor(F.col("slot") / ROWS_PER_BUCKET).alias("chunk"))
    counts = chunked.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    return chunked.join(before, ["source", "chunk"]).select(
        "slot", "source", (F.col("before") + F.row_number().over(within) - 1).alias("turn")
    )


def mix(lengths: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 20) -> DataFrame:
    """(slot, source, doc_id, n_tokens, repetition): the mixed corpus; ``lengths`` has doc_id, source, n_tokens."""
    spark = lengths.sparkSession
    usable = lengths.where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").select("source", "doc_id", "n_tokens")
    stock = usable.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    sources = checkpoint(source_plan(stock, targets, block_tokens))
    slots = sources.agg(F.max("slots").alias("n")).first()["n"]
    if not slots:
        return spark.createDataFrame([], "slot long, source string, doc_id long, n_tokens long, repetition int")
    usable = usable.join(sources.select("source"), "source", "left_semi")
    turns = _schedule(spark, sources, slots).join(sources.select("source", "blocks", "repeat"), "source")
    turns = turns.select(
        "slot", "source", (F.col("turn") % F.col("blocks")).cast("long").alias("block"), F.floor(F.col("turn") / F.col("blocks")).cast("int").alias("lap"), "repeat"
    )
    # The sequence may run a slot or two ahead of a source's last permitted lap.
    turns = turns.where(F.col("lap") < F.col("repeat"))
    stocked = _stocked_blocks(usable, sources, seed)
    return turns.join(stocked, ["source", "block"]).select(
        "slot", "source", "doc_id", "n_tokens", (F.col("lap") + 1).alias("repetition")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, share reached, tokens, texts, uses and most repetitions."""
    uses = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.countDistinct("doc_id").alias("n_texts"),
        F.max("repetition").alias("most_repetitions"),
    )
    # One row per target source, so one partition holds them all.
    uses = uses.withColumn("total", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    kept = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max("part_cible").alias("part_cible"), F.max("repetitions_max").alias("repetitions_max")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return kept.join(uses, "source", "left").select(
        "source", "part_cible", F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("part_reelle"),
        "repetitions_max", zero("n_tokens"), zero("n_texts"), zero("n_uses"), zero("most_repetitions"),
    )


def corpus_lengths(counted: DataFrame) -> DataFrame:
    """Token counts kept once for the passes that need them."""
    return checkpoint(counted)
