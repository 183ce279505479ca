"""Bootstrap statistics with resamples that any engine can repeat: indices are hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DRAWS = 1024


def drawn(b: str, i: str, n: Column, seed: int) -> Column:
    """Which sample (from 0) draw i of resample b takes."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(b).cast("string"), F.col(i).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def resampled_means(samples: DataFrame, keys: list[str], value: str, resamples: int, seed: int = 42) -> DataFrame:
    """keys, b, m: the mean of each resample. samples have idx from 0 within the keys.

    Draws are dealt out in runs of DRAWS, so that they are made by all tasks and not where the few
    sizes lie, and meet the values by one shuffle: no side is broadcast, since the planner would
    take the draws for as small as the sizes they come from.
    """
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    runs = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    runs = runs.select(*keys, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))).alias("first")).repartition(parts, *keys, "b", "first")
    places = F.sequence(F.col("first"), F.least(F.col("first") + DRAWS, F.col("n")) - 1)
    draws = runs.select(*keys, "n", "b", F.explode(places).alias("i")).select(*keys, "n", "b", drawn("b", "i", F.col("n"), seed).alias("idx"))
    values = samples.select(*keys, "idx", value).hint("shuffle_hash")
    return draws.join(values, [*keys, "idx"]).groupBy(*keys, "b").agg((F.sum(value) / F.first("n")).alias("m"))


def bootstrap_ci(samples: DataFrame, keys: list[str], value: str, resamples: int, seed: int = 42) -> DataFrame:
    """keys, n, mean, ci_low, ci_high; with one sample all three are its value."""
    boot = resampled_means(samples, keys, value, resamples, seed).groupBy(*keys).agg(
        F.round(F.percentile("m", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("ci_high")
    )
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).join(boot, keys)


def paired(best: DataFrame, others: DataFrame, higher: bool = True) -> DataFrame:
    """model, idx, diff: best minus other of the same index, so that a positive difference favours the best."""
    j = others.join(best.select("idx", F.col("value").alias("top")), "idx")
    sign = 1 if higher else -1
    return j.select("model", "idx", (sign * (F.col("top") - F.col("value"))).alias("diff"))


def paired_bootstrap(diffs: DataFrame, resamples: int, seed: int = 42) -> DataFrame:
    """model, n, diff, ci_low, ci_high, p: twice the smaller share of resamples on either side of zero."""
    boot = resampled_means(diffs, ["model"], "diff", resamples, seed)
    side = lambda c: F.avg(c.cast("int"))
    t = boot.groupBy("model").agg(
        F.round(F.percentile("m", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("ci_high"),
        F.round(F.least(F.lit(1.0), 2 * F.least(side(F.col("m") <= 0), side(F.col("m") >= 0))), 6).alias("p"),
    )
    return diffs.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("diff")).join(t, "model")


def best_per_metric(means: DataFrame, keys: list[str], higher: Column, least_models: int = 2) -> DataFrame:
    """keys, best_model, mean, models of rows (keys, model, mean): the greatest mean, or the least where higher is false; ties go by name."""
    rank = F.struct(F.when(higher, -F.col("mean")).otherwise(F.col("mean")).alias("by"), "model", "mean")
    g = means.groupBy(*keys).agg(F.min(rank).alias("best"), F.count("*").alias("models")).filter(F.col("models") >= least_models)
    return g.select(*keys, F.col("best.model").alias("best_model"), F.round("best.mean", 6).alias("mean"), "models")
