"""Sinks: sharded samples with a manifest, results as JSON, append-only logs, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(samples: DataFrame, path: str, rows_per_file: int = 100_000, overwrite: bool = True) -> None:
    """Parquet files of bounded size; the committer makes the folder appear whole or not at all."""
    w = samples.write.option("maxRecordsPerFile", rows_per_file)
    w.mode("overwrite" if overwrite else "error").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, samples of a folder of shards."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("shard")).agg(F.count("*").alias("samples"))


def write_once(df: DataFrame, path: str) -> None:
    """A derived cache: left as it is where it exists."""
    df.write.mode("ignore").parquet(path)


def write_result(df: DataFrame, path: str, speed_prefix: str = "speed_") -> None:
    """A result as JSON, its speed metrics beside it."""
    speed = [c for c in df.columns if c.startswith(speed_prefix)]
    df.drop(*speed).coalesce(1).write.mode("overwrite").json(path)
    if speed:
        df.select(*speed).coalesce(1).write.mode("overwrite").json(f"{path}_speed")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latex_table(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a LaTeX table; nulls are ---."""
    from ..reporting import latex

    return latex(df.columns, [tuple(r) for r in df.limit(most).collect()])
