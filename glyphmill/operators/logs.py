"""Training-log analytics. A log has rows (run, row, step, metrics); every order is within a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names under which a metric has been logged, in lower case.
SYNONYMS = {
    "val_loss": ("val/loss", "val/val_loss", "val_loss"),
    "val_ppl": ("val/ppl", "val/val_ppl", "val_ppl"),
    "train_loss": ("train/loss", "train_loss"),
    "tps": ("speed/tps", "tokens_per_sec", "tps"),
}


def canonical(key: Column) -> Column:
    """One name for the synonyms of a metric, whatever their case; other names in lower case."""
    out = F.lower(key)
    for name, keys in SYNONYMS.items():
        out = F.when(F.lower(key).isin(*keys), F.lit(name)).otherwise(out)
    return out


def carried_step(run: str, order: str, step: str = "step") -> Column:
    """The step, or where it is missing the last one before."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(step), F.last(step, ignorenulls=True).over(before))


def best_so_far(run: str, order: str, value: str) -> Column:
    """Whether a value is strictly below all before it."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(value).over(before)
    return least.isNull() | (F.col(value) < least)


def stopped_at(rows: DataFrame, run: str, order: str, value: str, patience: int, delta: float = 0.0, min_steps: int = 0) -> DataFrame:
    """run, stop: the first place at which the value has not improved by delta for so many evaluations; null if never.

    Evaluations before min_steps, and values that are missing or not finite, do not count.

    A fold per run over its evaluations; an evaluation log is small by nature, one row per evaluation.
    """
    counts = (F.col(order) >= min_steps) & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    seq = F.array_sort(F.collect_list(F.when(counts, F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(a: Column, x: Column) -> Column:
        better = a["best"].isNull() | (a["best"] - x["v"] >= delta)
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        best = F.when(better, x["v"]).otherwise(a["best"])
        stop = F.coalesce(a["stop"], F.when(bad >= patience, x["o"].cast("long")))
        return F.struct(best.alias("best"), bad.cast("int").alias("bad"), stop.alias("stop"))

    return rows.groupBy(run).agg(F.aggregate(seq, start, step, lambda a: a["stop"]).alias("stop"))


def to_quality(rows: DataFrame, run: str, order: str, value: str, shares: tuple[int, ...] = (80, 90, 95, 99)) -> DataFrame:
    """run, share, step: the first place that has made so many percent of the way from the first value to the best."""
    ends = rows.groupBy(run).agg(F.min_by(value, order).alias("first"), F.min(value).alias("best"))
    wanted = ends.select(run, F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "first", "best")
    wanted = wanted.select(run, "share", (F.col("first") - F.col("share") / 100.0 * (F.col("first") - F.col("best"))).alias("target"))
    return rows.join(wanted, run).filter(F.col(value) <= F.col("target")).groupBy(run, "share").agg(F.min(order).alias("step"))


def max_steps(configured: Column, batches: Column, accumulation: Column) -> Column:
    """A positive configured number; else one pass over the batches."""
    return F.when(configured > 0, configured).otherwise(F.floor(batches / F.greatest(F.lit(1), accumulation))).cast("long")


def steps_per_epoch(recorded: Column, samples: Column, batch: Column, accumulation: Column) -> Column:
    """The recorded number; else whole optimiser steps of the samples, one at least."""
    return F.coalesce(recorded, F.greatest(F.lit(1), F.floor(samples / (batch * accumulation)))).cast("long")


def axis_band(df: DataFrame, group: str, value: str, low: float, high: float, coverage: float = 0.95, margin: float = 0.04) -> DataFrame:
    """group, lo, hi: the given band, or up to the value that takes the wanted share of points in, with a margin.

    Where too few points lie above the lower end for that share, the band ends at the largest value.
    """
    c = df.groupBy(group, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(group)
    run = F.sum(F.when(F.col(value) >= low, F.col("n")).otherwise(0)).over(own.orderBy(value))
    r = c.select(group, F.col(value).alias("v"), run.alias("upto"), F.sum("n").over(own).alias("total"))
    enough = F.min(F.when(F.col("upto") >= F.ceil(F.lit(coverage) * F.col("total")), F.col("v")))
    top = r.groupBy(group).agg(F.greatest(F.lit(high), F.coalesce(enough, F.max("v"))).alias("h"))
    wider = F.col("h") + F.greatest((F.col("h") - low) * margin, F.abs("h") * 1e-5, F.lit(1e-6))
    return top.select(group, F.lit(low).alias("lo"), F.round(F.when(F.col("h") > high, wider).otherwise(F.col("h")), 6).alias("hi"))


def stop_gates(df: DataFrame, run: str, step: str, micros: str, speed: str, seconds: int, steps: int, least_speed: float, warm_up: int) -> DataFrame:
    """run, by_clock, by_steps, by_speed: the first step at which each rule would end the run."""
    own = Window.partitionBy(run)
    e = df.select("*", F.row_number().over(own.orderBy(step)).alias("_k"), F.min(micros).over(own).alias("_began"))
    first = lambda rule: F.min(F.when(rule, F.col(step)))
    return e.groupBy(run).agg(
        first(F.col(micros) - F.col("_began") >= seconds * 1_000_000).alias("by_clock"), first(F.col("_k") >= steps).alias("by_steps"),
        first((F.col("_k") > warm_up) & (F.col(speed) < least_speed)).alias("by_speed"),
    )
