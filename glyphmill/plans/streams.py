"""Streaming queries: each drains a stream of the events table and is compared with the batch answer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import stateful as ops
from .registry import query, table


def _drained(spark, d, build, mode):
    schema = table(spark, d, "events").schema
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="glyphmill-stream-")
    name = f"stream_{uuid.uuid4().hex}"
    return ops.drained(build(ops.read_stream(spark, d, schema, "events.parquet")), name, mode, f"{shared}/{name}")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return _drained(spark, d, lambda e: ops.tumbling(e, "1 hour"), "complete")


@query("stream_step_windows", "SELECT event_id // 100 AS window, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_step_windows(spark, d):
    return _drained(spark, d, lambda e: ops.step_windows(e, 100), "complete")


@query("stream_early_stopping", """
WITH RECURSIVE o AS (SELECT user_id AS run, event_id AS row, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT run, k, value AS best, 0 AS bad, CAST(NULL AS BIGINT) AS stop FROM o WHERE k = 1
  UNION ALL
  SELECT o.run, o.k, least(f.best, o.value), CASE WHEN f.best - o.value >= 0 THEN 0 ELSE f.bad + 1 END,
         coalesce(f.stop, CASE WHEN f.best - o.value < 0 AND f.bad + 1 >= 10 THEN o.row END) FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1)
SELECT run, max(stop) AS stop FROM f GROUP BY run HAVING max(stop) IS NOT NULL""")
def stream_early_stopping(spark, d):
    return _drained(spark, d, lambda e: ops.early_stops(e, 10), "append")


@query("stream_packing", """
WITH RECURSIVE w AS (SELECT event_type AS bucket, 1 + event_id % 90 AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
f AS (
  SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS sample FROM w
  UNION ALL
  SELECT w.bucket, w.rn, CASE WHEN f.used + w.n <= 256 THEN f.used + w.n ELSE w.n END, f.sample + CASE WHEN f.used + w.n <= 256 THEN 0 ELSE 1 END FROM f JOIN w ON w.bucket = f.bucket AND w.rn = f.rn + 1),
l AS (SELECT bucket, max(sample) AS open_ FROM f GROUP BY bucket)
SELECT f.bucket, sample AS sample_id, max(used) AS used FROM f JOIN l ON l.bucket = f.bucket AND sample < open_ GROUP BY f.bucket, sample""")
def stream_packing(spark, d):
    """The full samples of each type; the open ones wait for more rows."""
    sized = lambda e: e.select("event_type", "event_id", (1 + F.col("event_id") % 90).alias("n"))
    return _drained(spark, d, lambda e: ops.packed_samples(sized(e), "event_type", "event_id", "n", 256), "append")
