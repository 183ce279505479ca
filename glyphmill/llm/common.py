"""Shared folder, spooled tables and small helpers for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_OPEN: list[Spool] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a local session has none (tests, a laptop) one is made for the process; on a cluster
    that would be a folder of one machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="glyphmill-")
    return _OWN["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


class Spool:
    """Tables written once to the shared folder, so that a lost executor costs no earlier stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spool/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)
        _OPEN.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; what the write shuffled is given free at once."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_FREE, "false")
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """For a table that no later plan reads."""
        _delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """All its tables; nothing read from them may be used any more."""
        _delete(self.spark, self.root)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, all spools made inside: for work whose result has been written elsewhere."""
    mark = len(_OPEN)
    try:
        yield
    finally:
        while len(_OPEN) > mark:
            _OPEN.pop().close()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for the jobs run inside; names with __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sifted(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Joins of texts with few wanted keys drop most texts before the shuffle.

    The planner's own filter of bounded size (at most 8 MB, a scalar of the plan) does it; where
    keys are too many for it, it lets more rows through, none too few.
    """
    name = "spark__sql__optimizer__runtime__bloomFilter__"
    return settings(spark, **{name + "enabled": "true", name + "applicationSideScanSizeThreshold": "0", name + "creationSideThreshold": "1g"})


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under plain names; extra columns of any name do no harm."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
