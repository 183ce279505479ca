"""Queries over report tables: samples, significance, cross tables, overlays. A source is a model, documents its examples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import reporting
from ..operators import stats
from .registry import query, table

#: All examples of all models. A number made of n_chars stands for a score.
_S = """s AS (SELECT source AS model, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS idx, CAST(n_chars % 100 AS DOUBLE) AS value
  FROM documents WHERE source IS NOT NULL)"""
_DRAW = "CAST(('0x' || substring(md5('42:' || b || ':' || i), 1, 8)) AS BIGINT)"


def _samples(spark, d):
    docs = table(spark, d, "documents").filter("source is not null")
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("source").alias("model"), (rn - 1).cast("long").alias("idx"), (F.col("n_chars") % 100).cast("double").alias("value"))


def _best(samples):
    return samples.groupBy("model").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "model").limit(1)


@query("metric_samples", f"WITH {_S} SELECT model, idx, value FROM s")
def metric_samples(spark, d):
    return _samples(spark, d)


@query("best_model", f"WITH {_S}, m AS (SELECT model, avg(value) AS mean FROM s GROUP BY model) SELECT model, round(mean, 6) AS mean FROM m ORDER BY mean DESC, model LIMIT 1")
def best_model(spark, d):
    return _best(_samples(spark, d)).select("model", F.round("mean", 6).alias("mean"))


@query("paired_diff", f"""
WITH {_S}, b AS (SELECT model FROM s GROUP BY model ORDER BY avg(value) DESC, model LIMIT 1)
SELECT o.model, o.idx, t.value - o.value AS diff FROM s o JOIN s t ON t.idx = o.idx AND t.model = (SELECT model FROM b) WHERE o.model <> (SELECT model FROM b)""")
def paired_diff(spark, d):
    s = _samples(spark, d)
    best = _best(s).select("model")
    return stats.paired(s.join(F.broadcast(best), "model"), s.join(F.broadcast(best), "model", "left_anti"))  # one row


@query("bootstrap_ci", f"""
WITH {_S}, n AS (SELECT model, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY model),
dr AS (SELECT model, b, {_DRAW} % n AS idx FROM n, unnest(range(0, 100)) t(b), unnest(range(0, n)) u(i)),
m AS (SELECT dr.model, b, avg(value) AS m FROM dr JOIN s ON s.model = dr.model AND s.idx = dr.idx GROUP BY dr.model, b)
SELECT model, n, mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m JOIN n USING (model) GROUP BY model, n, mean""")
def bootstrap_ci(spark, d):
    return stats.bootstrap_ci(_samples(spark, d), ["model"], "value", 100)


_PB = f"""
{_S}, best AS (SELECT model FROM s GROUP BY model ORDER BY avg(value) DESC, model LIMIT 1),
p AS (SELECT o.model, o.idx, t.value - o.value AS diff FROM s o JOIN s t ON t.idx = o.idx AND t.model = (SELECT model FROM best) WHERE o.model <> (SELECT model FROM best)),
n AS (SELECT model, count(*) AS n, round(avg(diff), 6) AS diff FROM p GROUP BY model),
dr AS (SELECT model, b, {_DRAW} % n AS idx FROM n, unnest(range(0, 100)) t(b), unnest(range(0, n)) u(i)),
m AS (SELECT dr.model, b, avg(diff) AS m FROM dr JOIN p ON p.model = dr.model AND p.idx = dr.idx GROUP BY dr.model, b),
r AS (SELECT model, n, n.diff, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high,
  round(least(1.0::DOUBLE, 2 * least(avg(CAST(m <= 0 AS INTEGER)), avg(CAST(m >= 0 AS INTEGER)))), 6) AS p FROM m JOIN n USING (model) GROUP BY model, n, n.diff)"""


@query("paired_bootstrap", f"WITH {_PB} SELECT model, n, diff, ci_low, ci_high, p FROM r")
def paired_bootstrap(spark, d):
    return stats.paired_bootstrap(paired_diff(spark, d), 100)


@query("significance_flag", f"WITH {_PB} SELECT model, p >= 0.05 OR ci_low <= 0 AS tied FROM r UNION ALL SELECT model, true FROM best")
def significance_flag(spark, d):
    """Models that tie with the best one, for marking; the best ties with itself."""
    tied = paired_bootstrap(spark, d).select("model", ((F.col("p") >= 0.05) | (F.col("ci_low") <= 0)).alias("tied"))
    return tied.unionByName(_best(_samples(spark, d)).select("model", F.lit(True).alias("tied")))


@query("cross_perplexity", """
WITH m AS (SELECT source, lang, round(avg(n_chars), 4) AS v FROM documents GROUP BY source, lang)
SELECT source, max(v) FILTER (WHERE lang = 'en') AS en, max(v) FILTER (WHERE lang = 'fr') AS fr, max(v) FILTER (WHERE lang = 'de') AS de, max(v) FILTER (WHERE lang = 'es') AS es FROM m GROUP BY source""")
def cross_perplexity(spark, d):
    """Experiments by splits: one pivot, its columns given so that no pass looks for them."""
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.round(F.avg("n_chars"), 4))


@query("cross_rollup", "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def cross_rollup(spark, d):
    r = table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query("scalar_keys_union", "SELECT DISTINCT key FROM (SELECT event_type AS key FROM events UNION SELECT lang FROM documents UNION SELECT role FROM conversations)")
def scalar_keys_union(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("key")) for t, c in (("events", "event_type"), ("documents", "lang"), ("conversations", "role"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("discover_union", "SELECT DISTINCT source AS experiment FROM documents WHERE lang = 'en' UNION SELECT source FROM documents d JOIN labels l USING (doc_id) ORDER BY 1")
def discover_union(spark, d):
    docs = table(spark, d, "documents")
    logged = docs.filter("lang = 'en'").select("source")
    scored = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("source")
    return logged.unionByName(scored).distinct().select(F.col("source").alias("experiment")).orderBy("experiment")


@query("list_experiments", "SELECT DISTINCT lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def list_experiments(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("lang").distinct()


@query("split_sort", "SELECT lang, row_number() OVER (ORDER BY coalesce(nullif(list_position(['fr', 'en'], lang), 0), 99), lang) AS place FROM (SELECT DISTINCT lang FROM documents)")
def split_sort(spark, d):
    at = F.array_position(F.array(F.lit("fr"), F.lit("en")), F.col("lang"))
    own = Window.orderBy(F.when(at > 0, at).otherwise(99), "lang")  # a handful of split names
    return table(spark, d, "documents").select("lang").distinct().select("lang", F.row_number().over(own).alias("place"))


@query("config_overlay", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.quality, a.n_chars % 2) AS value FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id")
def config_overlay(spark, d):
    """Defaults under overrides: a full join on the key, the override first."""
    a = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("v"))
    return a.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "full").select("doc_id", F.coalesce("quality", "v").alias("value"))


@query("summary_merge", "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.toxic, o.quality) AS field FROM (SELECT * FROM labels WHERE doc_id % 2 = 0) n FULL JOIN (SELECT * FROM labels WHERE doc_id % 3 = 0) o ON n.doc_id = o.doc_id")
def summary_merge(spark, d):
    """A rebuilt summary keeps fields of the old one that it lacks."""
    n = table(spark, d, "labels").filter("doc_id % 2 = 0").select("doc_id", "toxic")
    o = table(spark, d, "labels").filter("doc_id % 3 = 0").select("doc_id", "quality")
    return n.join(o, "doc_id", "full").select("doc_id", F.coalesce("toxic", "quality").alias("field"))


@query("split_speed_metrics", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'speed' ELSE 'quality' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def split_speed_metrics(spark, d):
    part = F.when(F.col("event_type").isin("view", "click"), "speed").otherwise("quality")
    return table(spark, d, "events").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("missing_display", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '---') AS shown FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def missing_display(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("---")).alias("shown"))


@query("map_mean", "SELECT item_id, round((len(text) + item_id + 7) / 3.0::DOUBLE, 9) AS mean FROM benchmark")
def map_mean(spark, d):
    """Mean over the scorers of a map of scores."""
    m = F.create_map(F.lit("a"), F.char_length("text").cast("double"), F.lit("b"), F.col("item_id").cast("double"), F.lit("c"), F.lit(7.0))
    return table(spark, d, "benchmark").select("item_id", F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x) / F.size(m), 9).alias("mean"))


@query("language_summary", """
WITH s AS (SELECT lang, source AS model, n_chars % 100 AS score, n_chars % 37 AS loss FROM documents WHERE source IS NOT NULL),
m AS (SELECT lang, 'score' AS metric, true AS higher, model, avg(score) AS mean FROM s GROUP BY lang, model UNION ALL SELECT lang, 'loss', false, model, avg(loss) FROM s GROUP BY lang, model),
r AS (SELECT *, count(*) OVER (PARTITION BY lang, metric) AS models, row_number() OVER (PARTITION BY lang, metric ORDER BY CASE WHEN higher THEN -mean ELSE mean END, model) AS rn FROM m)
SELECT lang, metric, model AS best_model, round(mean, 6) AS mean, models FROM r WHERE rn = 1 AND models >= 2""")
def language_summary(spark, d):
    """Per language and metric of two models or more: the best model, whichever way the metric points."""
    s = table(spark, d, "documents").filter("source is not null").groupBy("lang", F.col("source").alias("model"))
    means = s.agg(F.avg(F.col("n_chars") % 100).alias("score"), F.avg(F.col("n_chars") % 37).alias("loss"))
    long = means.unpivot(["lang", "model"], ["score", "loss"], "metric", "mean")
    return stats.best_per_metric(long, ["lang", "metric"], F.col("metric") == "score")


@query("details_dropped", "SELECT event_id, event_id % 4 + 1 AS num_examples, value AS score, user_id % 3 + 1 AS num_generations, event_type AS kind FROM events")
def details_dropped(spark, d):
    """Nested results without their example lists, which leave their lengths."""
    listed = lambda c, n: F.sequence(F.lit(0).cast("long"), F.col(c) % n)
    inner = F.struct(listed("user_id", 3).alias("generations"), F.col("event_type").alias("kind"), F.lit("x").alias("detailed_results_en"))
    r = table(spark, d, "events").select("event_id", F.struct(F.col("value").alias("score"), listed("event_id", 4).alias("examples"), inner.alias("inner")).alias("result"))
    return reporting.without_details(r).select("event_id", "result.num_examples", "result.score", "result.inner.num_generations", "result.inner.kind")
