"""Packing, sharding and shuffling of samples.

Next-fit packing is a fold over ordered lines. It runs per bucket (a source, a range of ids),
each a group of its own; lines of a bucket are folded as they stream by, so a task holds one
open sample and never a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_point(ids: list[int], most: int, ends: frozenset[int]) -> int:
    if len(ids) <= most:
        return len(ids)
    for i in range(most - 1, max(0, most - 200), -1):
        if ids[i] in ends:
            return i + 1
    return most


def next_fit(lines: Iterator[list[int]], context: int, pad: int, ends: frozenset[int]) -> Iterator[list[int]]:
    """A line goes into the open sample if it fits whole; else that one is padded and given out. Over-long lines are cut."""
    held: list[int] = []
    full = lambda s: s + [pad] * (context - len(s))
    for ids in lines:
        while ids:
            if len(ids) <= context - len(held):
                held, ids = held + ids, []
                break
            if not held:
                n = split_point(ids, context, ends)
                held, ids = ids[:n], ids[n:]
            yield full(held)
            held = []
    if held:
        yield full(held)


def next_fit_text(lines: Iterator[str], context: int) -> Iterator[str]:
    """Lines with their line ends, at most context - 2 characters a sample; over-long lines are cut. Line ends are escaped."""
    budget, held = context - 2, ""
    for line in lines:
        line = line.strip() + "\n"
        pieces = [line] if len(line) <= budget else [line[i : i + budget] for i in range(0, len(line), budget)]
        if len(pieces) > 1 and held:
            yield held.replace("\n", "\\n")
            held = ""
        for p in pieces:
            if len(held) + len(p) > budget and held:
                yield held.replace("\n", "\\n")
                held = ""
            held += p
    if held:
        yield held.replace("\n", "\\n")


def folded(df: DataFrame, bucket: str, order: list[str], value: str, fold: Callable[[Iterator], Iterator], kind: str, name: str) -> DataFrame:
    """bucket, sample_id, name: the fold over each bucket's values in order, one row a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        nxt = next(rows, None)
        while nxt is not None:
            key = nxt[0]

            def own():
                nonlocal nxt
                while nxt is not None and nxt[0] == key:  # noqa: B023
                    v = nxt[1]
                    nxt = next(rows, None)
                    yield v

            part: list = []
            number = 0
            for s in fold(own()):
                part.append((key, number, s))
                number += 1
                if len(part) >= 500:
                    yield _batch(part)
                    part = []
            if part:
                yield _batch(part)

    def _batch(part: list) -> pa.RecordBatch:
        k, i, s = zip(*part, strict=True)
        out = pa.array(s, pa.list_(pa.int32())) if kind.startswith("array") else pa.array(s, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i, pa.int64()), out], [bucket, "sample_id", name])

    d = df.select(bucket, *order, value).repartition(bucket).sortWithinPartitions(bucket, *order).select(bucket, value)
    return d.mapInArrow(run, f"{bucket} {dict(df.dtypes)[bucket]}, sample_id long, {name} {kind}")


def pack_tokens(lines: DataFrame, bucket: str, order: list[str], context: int, pad: int, ends: frozenset[int], ids: str = "ids") -> DataFrame:
    return folded(lines, bucket, order, ids, lambda x: next_fit(x, context, pad, ends), "array<int>", "input_ids")


def pack_lazy(lines: DataFrame, bucket: str, order: list[str], context: int, text: str = "line") -> DataFrame:
    return folded(lines, bucket, order, text, lambda x: next_fit_text(x, context), "string", "text")


def shuffled(df: DataFrame, key: str, seed: int, buckets: int) -> DataFrame:
    """key, bucket, place: a global shuffle by hash, into buckets and then within them."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    d = df.select(key, h.alias("h")).withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets))
    return d.select(key, "bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)).alias("place"))


def shard_sizes(df: DataFrame, shard: str) -> DataFrame:
    """shard, samples, offset: where each shard begins among all samples (one row per shard)."""
    sizes = df.groupBy(shard).agg(F.count("*").alias("samples"))
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(shard, "samples", F.coalesce(F.sum("samples").over(before), F.lit(0)).alias("offset"))
