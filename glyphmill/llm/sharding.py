"""Minimax contiguous partition of documents into shards, in DataFrame operations only.

Atomic groups are documents of equal text, ordered by a 64-bit hash of the text. The smallest
feasible capacity is found by binary search with a greedy check, as for an array; but the
array is never gathered: groups are summed by a prefix of the hash (at most 65,536 sums),
the greedy cuts of a feasible and of an infeasible capacity bound where each true cut can
lie, and only those prefixes are opened, eight more bits at a time, until every cut falls
between two groups. The few groups above 1/1024 of all bytes stand alone from the start, each
after the other groups of its prefix. A shard is then a comparison with seven constants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, only

SHARDS = 8
FIRST_BITS, STEP_BITS, SLOT_BUCKETS, BIG = 16, 8, 1024, 1024


@dataclass(order=True, frozen=True)
class Unit:
    """Groups next to each other in the order; prefix, big and h say where they begin."""

    prefix: int
    big: bool
    h: int
    bits: int
    size: int
    groups: int


def _top(h: Column, bits: int) -> Column:
    return F.shiftright(h, 64 - bits)  # arithmetic, so prefixes are in the order of signed longs


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> tuple[list[int], bool]:
    """Items each shard ends before; whether all items fit. ends: running totals."""
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        cuts.append(at)
        done = int(ends[at - 1]) if at else 0
    return cuts, at == len(ends)


def smallest_capacity(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The minimax capacity of a contiguous partition and its greedy cuts."""
    if not len(sizes):
        return 0, [0] * shards
    ends = np.cumsum(sizes.astype(np.int64))
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(ends, mid, shards)[1] else (mid + 1, high)
    return low, _greedy(ends, low, shards)[0]


def _windows(sizes: np.ndarray, single: np.ndarray, shards: int) -> np.ndarray:
    """Which units a true cut can fall into, for units of which some hold several groups.

    The best capacity over whole units is feasible, so the true one is at most that; it is at
    least the mean and the largest single group. Greedy cuts move right as the capacity grows:
    cuts over whole units at the lower bound are at or left of the true ones, and cuts that
    may fall inside units at the upper bound are at or right of them.
    """
    ends = np.cumsum(sizes.astype(np.int64))
    total = int(ends[-1])
    high, _ = smallest_capacity(sizes, shards)
    low = max(-(-total // shards), int(sizes[single].max()) if single.any() else 1)
    opened = np.zeros(len(sizes), bool)
    left_done = right_done = 0
    for _ in range(shards - 1):
        a = int(np.searchsorted(ends, left_done + low, side="right"))
        left_done = int(ends[a - 1]) if a else 0
        b = int(np.searchsorted(ends, right_done + high, side="right"))
        right_done = min(right_done + high, total)
        opened[a : b + 1] = True
    return opened & ~single


def _units(groups: DataFrame, bits: int, big: list[int], among: list[int] | None = None) -> list[Unit]:
    """Sums by prefix (only of the prefixes STEP_BITS shorter in among), big groups apart."""
    g = groups.withColumn("big", F.col("h").isin(big) if big else F.lit(False))
    if among is not None:
        g = g.filter(~F.col("big") & _top(F.col("h"), bits - STEP_BITS).isin(among))
    rows = g.groupBy(_top(F.col("h"), bits).alias("p"), "big", F.when(F.col("big"), F.col("h")).alias("own")).agg(
        F.min("h").alias("h"), F.sum("size").alias("size"), F.count("*").alias("n")
    )
    return [Unit(r.h >> 64 - FIRST_BITS, r.big, r.h, bits, r["size"], r.n) for r in rows.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[Unit], list[int]]:
    """The units that shards 1, 2, ... begin with (fewer where shards stay empty), and the big groups' hashes."""
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return [], []
    big = [r.h for r in groups.filter(F.col("size") > total // BIG).select("h").collect()]  # fewer than BIG
    units = sorted(_units(groups, FIRST_BITS, big))
    while True:
        sizes, single = np.array([u.size for u in units]), np.array([u.groups == 1 for u in units])
        opened = [u for u, o in zip(units, _windows(sizes, single, shards), strict=True) if o]
        if not opened:
            break
        kept = set(units) - set(opened)
        for bits in {u.bits for u in opened}:
            kept.update(_units(groups, bits + STEP_BITS, big, [u.h >> 64 - bits for u in opened if u.bits == bits]))
        units = sorted(kept)
    return [units[c] for c in smallest_capacity(sizes, shards)[1][: shards - 1] if c < len(units)], big


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes, equal texts together.

    size: UTF-8 bytes + 1; a null text counts as empty, so null and empty texts are one group.
    The largest shard is as small as contiguous cuts of the order allow. slot counts from 0
    without gaps in each shard. Repeated rows are rows of their own; null ids stay null; an
    empty table gives no rows, and shards can be empty. Other columns are not read.
    """
    spool = Spool(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")
    )
    rows = spool.put(rows, "rows")  # the texts are read once
    cuts, big = minimax_cuts(spool.put(rows.groupBy("h").agg(F.sum("size").alias("size")), "groups"), shards)
    spool.drop("groups")
    place = F.struct(_top(F.col("h"), FIRST_BITS), F.col("h").isin(big) if big else F.lit(False), F.col("h"))
    shard = sum(((place >= F.struct(F.lit(u.prefix).cast("long"), F.lit(u.big), F.lit(u.h).cast("long"))).cast("int") for u in cuts), F.lit(0))
    placed = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * SLOT_BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "size")
    return (
        placed.withColumn("r", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("r")).cast("long").alias("slot"))
    )


def report(docs: DataFrame) -> DataFrame:
    return shard_by_bytes(docs).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
