"""Problem 6: what changed between full snapshots.

Rows shrink to a 128-bit key hash and a 64-bit row hash, fall into hash buckets of bounded
size, and each bucket's snapshots are compared in numpy by sorted set differences.  Full
values are fetched only for the keys that differ.

Defined results: rows without key or snapshot number take no part.  Of several rows of one
key in a snapshot the one latest in ``order`` holds; on a tie, or without ``order``, the one
with the greatest row hash, so the result never depends on row order.  The first snapshot
reports nothing; consecutive means next among the numbers present in the table.  Very hot
keys are combined before the shuffle.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bocage.session import bucket_count

ROWS_PER_BUCKET = 200_000
KINDS = ("added", "removed", "changed")
_DIFF_SCHEMA = "k1 long, k2 long, snapshot_no int, previous_no int, change_kind string"


def careless_text(value: Column) -> Column:
    """Text compared without letter case, outer blanks and repeated blanks; null is empty."""
    blanks = r"[\s\u0085   -     　]+"
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), blanks, " ")))


def _compact(df: DataFrame, snapshot: str, key: Column, values: Sequence[Column], order: str | None) -> DataFrame:
    """One compact row per (snapshot, key): key hashes, row hash of the holding row."""
    text = key.cast("string")
    # A null marker keeps (null, 'a') and ('a', null) apart, which hash alone would not.
    parts = [p for v in values for p in (v.isNull(), v)]
    rows = df.where(text.isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(snapshot).cast("int").alias("snap"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text, F.lit(2)).alias("k2"),
        F.xxhash64(*parts).alias("row_hash"),
        (F.col(order).cast("timestamp_ntz") if order else F.lit(None).cast("timestamp_ntz")).alias("at"),
    )
    return rows.groupBy("snap", "k1", "k2").agg(F.max(F.struct("at", "row_hash")).alias("last")).select(
        "snap", "k1", "k2", F.col("last.row_hash").alias("row_hash")
    )


def _differ(numbers: list[int]):
    """The comparison of one bucket, for the snapshot numbers in ascending order."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        pairs = np.empty(len(bucket), dtype=[("k1", "i8"), ("k2", "i8")])
        pairs["k1"], pairs["k2"] = bucket["k1"].to_numpy(), bucket["k2"].to_numpy()
        keys, code = np.unique(pairs, return_inverse=True)
        snap, row_hash = bucket["snap"].to_numpy(), bucket["row_hash"].to_numpy()
        by_snap = {}
        for n in numbers:
            at = np.flatnonzero(snap == n)
            at = at[np.argsort(code[at], kind="stable")]
            by_snap[n] = (code[at], row_hash[at])
        out = []
        for before, after in zip(numbers, numbers[1:]):
            (ka, ha), (kb, hb) = by_snap[before], by_snap[after]
            slot = np.searchsorted(ka, kb)
            there = np.zeros(len(kb), dtype=bool)
            inside = slot < len(ka)
            there[inside] = ka[slot[inside]] == kb[inside]
            changed = there.copy()
            changed[there] = ha[slot[there]] != hb[there]
            back = np.searchsorted(kb, ka)
            kept = np.zeros(len(ka), dtype=bool)
            inside = back < len(kb)
            kept[inside] = kb[back[inside]] == ka[inside]
            for kind, found in zip(KINDS, (kb[~there], ka[~kept], kb[changed])):
                if len(found):
                    out.append(
                        pd.DataFrame(
                            {
                                "k1": keys["k1"][found], "k2": keys["k2"][found], "snapshot_no": np.int32(after),
                                "previous_no": np.int32(before), "change_kind": kind,
                            }
                        )
                    )
        if out:
            return pd.concat(out, ignore_index=True)
        return pd.DataFrame({c.split()[0]: [] for c in _DIFF_SCHEMA.split(", ")})

    return run


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: str,
    values: Sequence[Column],
    order: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(record_key, snapshot_no, previous_no, change_kind) for each pair of consecutive snapshots."""
    sized = df.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("int").alias("n")).count().collect()
    numbers = sorted(r["n"] for r in sized)
    buckets = bucket_count(sum(r["count"] for r in sized), rows_per_bucket)
    compact = _compact(df, snapshot, F.col(key), values, order)
    diff = (
        compact.groupBy(F.pmod(F.col("k1"), F.lit(buckets)).alias("bucket"))
        .applyInPandas(lambda pdf: _differ(numbers)(pdf), _DIFF_SCHEMA)
    )
    text = F.col(key).cast("string")
    names = df.where(text.isNotNull()).select(
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("k2"), text.alias("record_key")
    ).distinct()
    return diff.join(names, ["k1", "k2"]).select("record_key", "snapshot_no", "previous_no", "change_kind")


def change_values(
    df: DataFrame, changes: DataFrame, snapshot: str, key: str, columns: Sequence[str], order: str | None = None
) -> DataFrame:
    """``changes`` with the full row before and after, as JSON; absent sides are null."""
    text = F.col(key).cast("string")
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    at = F.col(order).cast("timestamp_ntz") if order else F.lit(None).cast("timestamp_ntz")
    rows = df.select(F.col(snapshot).cast("int").alias("n"), text.alias("record_key"), body.alias("body"), at.alias("at"))
    # Only rows of differing keys travel on.
    rows = rows.join(changes.select("record_key").distinct(), "record_key", "left_semi")
    held = rows.groupBy("n", "record_key").agg(F.max(F.struct("at", "body"))["body"].alias("body"))
    before = held.select(F.col("n").alias("previous_no"), "record_key", F.col("body").alias("before"))
    after = held.select(F.col("n").alias("snapshot_no"), "record_key", F.col("body").alias("after"))
    return changes.join(before, ["record_key", "previous_no"], "left").join(after, ["record_key", "snapshot_no"], "left")
