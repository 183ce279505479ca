"""Queries over training logs. Events are the log: a user is a run, an event a row; every fifth row has no step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as t
from ..operators import logs as ops
from .registry import query, table

_LOG = "log AS (SELECT user_id AS run, event_id AS row, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS step, event_type AS key, value FROM events)"


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("row"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("step"), F.col("event_type").alias("key"), "value"
    )


@query("backfill_steps", f"WITH {_LOG} SELECT run, row, coalesce(step, last_value(step IGNORE NULLS) OVER (PARTITION BY run ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS step FROM log")
def backfill_steps(spark, d):
    return _log(spark, d).select("run", "row", ops.carried_step("run", "row").alias("step"))


@query("metric_series", f"WITH {_LOG} SELECT run, step, value FROM log WHERE step IS NOT NULL AND key = 'view'")
def metric_series(spark, d):
    return _log(spark, d).filter("step is not null and key = 'view'").select("run", "step", "value")


@query("normalize_metrics", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'val_loss' WHEN 1 THEN 'val_loss' WHEN 2 THEN 'val_ppl' WHEN 3 THEN 'tps' WHEN 4 THEN 'train_loss' ELSE 'other' END AS key, value FROM events""")
def normalize_metrics(spark, d):
    names = F.array(*[F.lit(x) for x in ("Val/Loss", "val/val_loss", "VAL_PPL", "Speed/TPS", "Train/Loss", "Other")])
    e = table(spark, d, "events").withColumn("key", F.get(names, (F.col("event_id") % 6).cast("int")))
    return e.select("event_id", ops.canonical(F.col("key")).alias("key"), "value")


@query("best_so_far", f"WITH {_LOG}, b AS (SELECT run, row, value, min(value) OVER (PARTITION BY run ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM log) SELECT run, row, value FROM b WHERE before_ IS NULL OR value < before_")
def best_so_far(spark, d):
    return _log(spark, d).withColumn("best", ops.best_so_far("run", "row", "value")).filter("best").select("run", "row", "value")


@query("early_stopping", f"""
WITH RECURSIVE {_LOG}, o AS (SELECT run, row, value, row_number() OVER (PARTITION BY run ORDER BY row) AS k FROM log),
f AS (
  SELECT run, k, value AS best, 0 AS bad, CAST(NULL AS BIGINT) AS stop FROM o WHERE k = 1
  UNION ALL
  SELECT o.run, o.k, least(f.best, o.value), CASE WHEN f.best - o.value >= 0 THEN 0 ELSE f.bad + 1 END,
         coalesce(f.stop, CASE WHEN f.best - o.value < 0 AND f.bad + 1 >= 10 THEN o.row END) FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1)
SELECT run, max(stop) AS stop FROM f GROUP BY run""")
def early_stopping(spark, d):
    return ops.stopped_at(_log(spark, d), "run", "row", "value", 10)


@query("steps_to_quality", f"""
WITH {_LOG}, e AS (SELECT run, arg_min(value, row) AS first, min(value) AS best FROM log GROUP BY run),
w AS (SELECT run, unnest([80, 90, 95, 99]) AS share, first, best FROM e),
t AS (SELECT run, share, first - share / 100.0::DOUBLE * (first - best) AS target FROM w)
SELECT t.run, t.share, min(row) AS step FROM log JOIN t ON t.run = log.run AND value <= target GROUP BY t.run, t.share""")
def steps_to_quality(spark, d):
    return ops.to_quality(_log(spark, d), "run", "row", "value")


@query("ppl_convergence", f"""
WITH {_LOG}, e AS (SELECT run, arg_min(value, row) AS first, min(value) AS best FROM log GROUP BY run)
SELECT log.run, round(best + 0.2::DOUBLE * (first - best), 6) AS threshold, min(row) FILTER (WHERE value <= best + 0.2::DOUBLE * (first - best)) AS step FROM log JOIN e USING (run) GROUP BY log.run, first, best""")
def ppl_convergence(spark, d):
    log = _log(spark, d)
    e = log.groupBy("run").agg(F.min_by("value", "row").alias("first"), F.min("value").alias("best"))
    cut = F.col("best") + F.lit(0.2) * (F.col("first") - F.col("best"))
    j = log.join(e, "run")
    return j.groupBy("run").agg(F.round(F.first(cut), 6).alias("threshold"), F.min(F.when(F.col("value") <= cut, F.col("row"))).alias("step"))


@query("training_summary", f"""
WITH {_LOG}
SELECT run, max(step) AS last_step, round(max(step) / 500.0::DOUBLE, 6) AS epochs, round(avg(value) FILTER (WHERE row % 5 <> 0), 6) AS mean_tps,
       min(value) FILTER (WHERE row % 5 = 0) AS best_val, arg_min(value, row) FILTER (WHERE row % 5 = 0) AS first_val, round(100.0::DOUBLE * max(step) / 500, 4) AS pct FROM log GROUP BY run""")
def training_summary(spark, d):
    train, val = F.col("row") % 5 != 0, F.col("row") % 5 == 0
    return _log(spark, d).groupBy("run").agg(
        F.max("step").alias("last_step"), F.round(F.max("step") / 500.0, 6).alias("epochs"), F.round(F.avg(F.when(train, F.col("value"))), 6).alias("mean_tps"),
        F.min(F.when(val, F.col("value"))).alias("best_val"), F.min_by(F.col("value"), F.when(val, F.col("row"))).alias("first_val"), F.round(100.0 * F.max("step") / 500, 4).alias("pct"),
    )


@query("weighted_window_mean", "SELECT event_id // 100 AS window, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def weighted_window_mean(spark, d):
    w = F.col("user_id") + 1
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("window")).agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"), F.count("*").alias("n"))


@query("weighted_ppl", "SELECT event_type, round(exp(sum(value / 100 * (user_id + 1)) / sum(user_id + 1)), 6) AS ppl FROM events GROUP BY event_type")
def weighted_ppl(spark, d):
    w = F.col("user_id") + 1
    return table(spark, d, "events").groupBy("event_type").agg(F.round(maths.safe_exp(F.sum(F.col("value") / 100 * w) / F.sum(w)), 6).alias("ppl"))


@query("lr_schedule", """
SELECT step, round(CASE WHEN step < 100 THEN 0.001::DOUBLE * (0.001::DOUBLE + 0.999::DOUBLE * step / 100) ELSE 0.00002::DOUBLE + (0.001::DOUBLE - 0.00002::DOUBLE) * (1 + cos(pi() * least(step - 100, 1900) / 1900)) / 2 END, 12) AS lr
FROM (SELECT unnest(range(0, 2000, 10)) AS step)""")
def lr_schedule(spark, d):
    return spark.range(0, 2000, 10).select(F.col("id").alias("step"), F.round(maths.learning_rate(F.col("id"), 0.001, 2000), 12).alias("lr"))


@query("phase_schedule", "SELECT step, CASE WHEN step < 200 THEN 'warmup' WHEN step < 500 THEN 'ramp' ELSE 'joint' END AS phase, round(CASE WHEN step < 200 THEN 0 WHEN step < 500 THEN (step - 200) / 300.0::DOUBLE ELSE 1 END, 9) AS weight FROM (SELECT unnest(range(0, 1000, 25)) AS step)")
def phase_schedule(spark, d):
    s = F.col("id")
    weight = F.when(s < 200, 0.0).when(s < 500, (s - 200) / 300.0).otherwise(1.0)
    return spark.range(0, 1000, 25).select(s.alias("step"), F.when(s < 200, "warmup").when(s < 500, "ramp").otherwise("joint").alias("phase"), F.round(weight, 9).alias("weight"))


@query("composite_score", "SELECT event_id, round(value + 2 * (user_id % 7) / 7.0::DOUBLE + 2 * (event_id % 3) + 4 * abs(value % 1 - 0.2::DOUBLE) + 0.25::DOUBLE * (value % 2), 6) AS score FROM events")
def composite_score(spark, d):
    """Loss, OOV and truncation rates, distance of the boundary rate from its aim, boundary loss."""
    v = F.col("value")
    s = v + 2 * (F.col("user_id") % 7) / 7.0 + 2 * (F.col("event_id") % 3) + 4 * F.abs(v % 1 - 0.2) + 0.25 * (v % 2)
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("score"))


@query("plateau_search", f"""
WITH {_LOG}, r AS (SELECT run, row, value, lag(value) OVER (PARTITION BY run ORDER BY row) AS before_ FROM log)
SELECT run, min(row) FILTER (WHERE value > 3 * before_) AS stop FROM r GROUP BY run""")
def plateau_search(spark, d):
    r = _log(spark, d).withColumn("before", F.lag("value").over(Window.partitionBy("run").orderBy("row")))
    return r.groupBy("run").agg(F.min(F.when(F.col("value") > 3 * F.col("before"), F.col("row"))).alias("stop"))


@query("progress_bands", f"WITH {_LOG}, m AS (SELECT run, min(row) AS lo, max(row) AS hi FROM log GROUP BY run) SELECT run, CAST(least(4, floor((row - lo) * 4.0::DOUBLE / greatest(1, hi - lo)) + 1) AS INTEGER) AS band, count(*) AS n, round(avg(value), 6) AS mean FROM log JOIN m USING (run) GROUP BY 1, 2")
def progress_bands(spark, d):
    own = Window.partitionBy("run")
    lo, hi = F.min("row").over(own), F.max("row").over(own)
    band = F.least(F.lit(4), F.floor((F.col("row") - lo) * 4.0 / F.greatest(F.lit(1), hi - lo)) + 1).cast("int")
    return _log(spark, d).withColumn("band", band).groupBy("run", "band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("explode_list_metrics", "SELECT vec_id, 'dim_' || (i - 1) AS key, embedding[i]::DOUBLE AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)")
def explode_list_metrics(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    x = x.select("vec_id", F.concat(F.lit("dim_"), F.col("i").cast("string")).alias("key"), F.col("x").cast("double").alias("value"))
    return x.filter(~F.isnan("value") & (F.abs("value") != float("inf")))


@query("experiment_duration", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds, count(*) AS n FROM events GROUP BY user_id")
def experiment_duration(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = F.floor((us(F.max("ts")) - us(F.min("ts"))) / 1_000_000)
    return table(spark, d, "events").groupBy("user_id").agg(span.alias("seconds"), F.count("*").alias("n"))


@query("best_checkpoint", "SELECT user_id, arg_min(event_id, value * 1000000 + event_id) AS event_id, min(value) AS value FROM events GROUP BY user_id")
def best_checkpoint(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.col("value") * 1000000 + F.col("event_id")).alias("event_id"), F.min("value").alias("value"))


@query("param_fallback", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, CASE WHEN doc_id % 2 = 0 THEN n_chars * 2 END, 512) AS n FROM documents")
def param_fallback(spark, d):
    """Checkpoint, then checkpoint total with the split of the configuration, then the configuration."""
    i, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(i % 3 == 0, n), F.when(i % 2 == 0, n * 2), F.lit(512)).alias("n"))


@query("training_steps", """
WITH n AS (SELECT source, count(*) AS samples, min(doc_id) % 3 AS kind FROM documents GROUP BY source)
SELECT source, CASE WHEN kind = 0 THEN 500 ELSE samples // 4 END AS max_steps, CASE WHEN kind = 1 THEN 77 ELSE greatest(samples // 12, 1) END AS steps_per_epoch FROM n""")
def training_steps(spark, d):
    """Every third source has its steps configured, another its steps per epoch recorded."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("samples"), (F.min("doc_id") % 3).alias("kind"))
    configured, recorded = F.when(F.col("kind") == 0, F.lit(500)).otherwise(F.lit(-1)), F.when(F.col("kind") == 1, F.lit(77))
    return n.select(
        "source", ops.max_steps(configured, F.col("samples"), F.lit(4)).alias("max_steps"), ops.steps_per_epoch(recorded, F.col("samples"), F.lit(3), F.lit(4)).alias("steps_per_epoch")
    )


@query("axis_band", """
WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT event_type, value, sum(CASE WHEN value >= 0 THEN n ELSE 0 END) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM c),
h AS (SELECT event_type, greatest(3.0::DOUBLE, coalesce(min(value) FILTER (WHERE upto >= ceil(0.95::DOUBLE * total)), max(value))) AS hi FROM r GROUP BY event_type)
SELECT event_type, 0.0::DOUBLE AS lo, round(CASE WHEN hi > 3 THEN hi + greatest(hi * 0.04::DOUBLE, hi * 0.00001::DOUBLE, 0.000001::DOUBLE) ELSE hi END, 6) AS hi FROM h""")
def axis_band(spark, d):
    return ops.axis_band(table(spark, d, "events"), "event_type", "value", 0.0, 3.0)


@query("stop_gates", """
WITH e AS (SELECT user_id AS run, event_id AS step, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, epoch_us(min(ts) OVER (PARTITION BY user_id)) AS began FROM events)
SELECT run, min(step) FILTER (WHERE us - began >= 3600000000) AS by_clock, min(step) FILTER (WHERE k >= 20) AS by_steps, min(step) FILTER (WHERE k > 5 AND value < 1) AS by_speed FROM e GROUP BY run""")
def stop_gates(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return ops.stop_gates(e, "run", "step", "us", "value", seconds=3600, steps=20, least_speed=1.0, warm_up=5)


@query("embedding_params", r"""
SELECT lang, n AS vocabulary, n * 64 AS tied, n * 128 AS untied FROM (SELECT lang, count(DISTINCT token) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n')) AS token FROM documents) GROUP BY lang)""")
def embedding_params(spark, d):
    """Parameters of the embedding, and of embedding and head, for 64 dimensions."""
    n = table(spark, d, "documents").select("lang", F.explode_outer(t.word_tokens(F.col("text"))).alias("token")).groupBy("lang").agg(F.count_distinct("token").alias("n"))
    return n.filter("n > 0").select("lang", F.col("n").alias("vocabulary"), (F.col("n") * 64).alias("tied"), (F.col("n") * 128).alias("untied"))
