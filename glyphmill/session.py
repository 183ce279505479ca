"""SparkSession factory with the engine's defaults; cluster settings win where they are set."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("glyphmill")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()
