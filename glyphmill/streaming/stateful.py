"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_STATE = "best double, bad int, stop long"


def read_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet") -> DataFrame:
    """A stream of the matching files of a folder; new files join it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", files).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total: metric windows, late rows up to a limit."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def step_windows(events: DataFrame, steps: int) -> DataFrame:
    """window, n, mean: logging windows by step."""
    return events.groupBy(F.floor(F.col("event_id") / steps).alias("window")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def early_stops(events: DataFrame, patience: int, delta: float = 0.0, min_steps: int = 0) -> DataFrame:
    """run, stop: emitted once per run when its value has not improved for so many rows. State is one row per run.

    Rows before min_steps, and values that are missing or not finite, do not count.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, bad, stop = state.get if state.exists else (None, 0, None)
        had = stop is not None
        rows = pd.concat(list(batches)).sort_values("event_id")
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            if i < min_steps or v is None or not math.isfinite(v):
                continue
            if best is None or best - v >= delta:
                best, bad = float(v), 0
            else:
                bad += 1
                if bad >= patience and stop is None:
                    stop = int(i)
        state.update((best, int(bad), stop))
        if stop is not None and not had:
            yield pd.DataFrame({"run": [key[0]], "stop": [stop]})

    return events.groupBy("user_id").applyInPandasWithState(update, "run long, stop long", STOP_STATE, "append", "NoTimeout")


PACK_STATE = "used long, sample long"


def packed_samples(events: DataFrame, bucket: str, order: str, size: str, context: int) -> DataFrame:
    """bucket, sample_id, used: next-fit samples, emitted once they are full. State is the open sample of each bucket.

    Over-long rows fill whole samples; what is open when the stream ends is not emitted.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, sample = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        full: list[int] = []
        for n in rows[size]:
            n = int(n)
            if used + n <= context:
                used += n
                continue
            if used:
                full.append(used)
            while n > context:
                full.append(context)
                n -= context
            used = n
        state.update((int(used), int(sample + len(full))))
        if full:
            yield pd.DataFrame({"bucket": [key[0]] * len(full), "sample_id": range(sample, sample + len(full)), "used": full})

    return events.groupBy(bucket).applyInPandasWithState(update, "bucket string, sample_id long, used long", PACK_STATE, "append", "NoTimeout")


def tailed_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """An append-only log of JSON lines as a stream; lines that are no objects come as nulls and go."""
    rows = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)
    return rows.dropna("all")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is and returns what it has put out."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
