"""Queries over evaluators: language-model scores, benchmarks, generation quality, speed, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as t
from ..operators import evaluation as ops
from ..operators import texts
from .registry import query, table

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n')"
_W = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_BIGRAMS = f"""
w AS (SELECT doc_id, lang, {_TOK} AS w FROM documents),
x AS (SELECT doc_id, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, lang, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM x),
p AS (SELECT * FROM g WHERE b IS NOT NULL),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b),
h AS (SELECT a, sum(n) AS total FROM c GROUP BY a),
m AS (SELECT c.a, c.b, c.n, ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (SELECT count(DISTINCT b) FROM c))) AS lp FROM c JOIN h USING (a))"""


@query("bigram_shift", f"WITH {_BIGRAMS} SELECT doc_id, count(*) AS pairs, count(DISTINCT b) AS followers FROM p GROUP BY doc_id")
def bigram_shift(spark, d):
    return ops.bigrams(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.countDistinct("b").alias("followers"))


@query("perplexity", f"""
WITH {_BIGRAMS}, l AS (SELECT lang, count(*) AS tokens, sum(-lp) AS loss FROM p JOIN m USING (a, b) GROUP BY lang),
ch AS (SELECT lang, CAST(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY lang)
SELECT lang, tokens, chars, round(exp(loss / tokens), 4) AS ppl, round(exp(loss / chars), 6) AS char_ppl FROM l JOIN ch USING (lang)""")
def perplexity(spark, d):
    return ops.perplexity(table(spark, d, "documents"), "lang")


@query("confidence", f"WITH {_BIGRAMS} SELECT doc_id, round(exp(avg(lp)) * 100, 6) AS confidence FROM p JOIN m USING (a, b) GROUP BY doc_id")
def confidence(spark, d):
    docs = table(spark, d, "documents")
    return ops.bigrams(docs).join(ops.bigram_model(docs), ["a", "b"]).groupBy("doc_id").agg(F.round(F.exp(F.avg("logprob")) * 100, 6).alias("confidence"))


@query("minimal_pair_accuracy", f"""
WITH {_BIGRAMS},
i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'swap_last' ELSE 'reverse' END AS phenomenon, {_TOK} AS g FROM benchmark),
v AS (SELECT item_id, phenomenon, 'good' AS kind, g AS w FROM i UNION ALL SELECT item_id, phenomenon, 'bad', list_reverse(g) FROM i),
y AS (SELECT item_id, phenomenon, kind, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM v),
z AS (SELECT item_id, phenomenon, kind, a, lead(a) OVER (PARTITION BY item_id, kind ORDER BY k) AS b FROM y),
s AS (SELECT item_id, phenomenon, kind, avg(-coalesce(lp, -12.0)) AS loss FROM z LEFT JOIN m USING (a, b) WHERE z.b IS NOT NULL GROUP BY item_id, phenomenon, kind),
r AS (SELECT phenomenon, item_id, max(loss) FILTER (WHERE kind = 'good') < max(loss) FILTER (WHERE kind = 'bad') AS ok FROM s GROUP BY phenomenon, item_id)
SELECT coalesce(phenomenon, 'total') AS phenomenon, count(*) AS n, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy FROM r GROUP BY ROLLUP (phenomenon)""")
def minimal_pair_accuracy(spark, d):
    """Mean token loss of an item must be below that of the item reversed; unseen pairs cost 12."""
    model = ops.bigram_model(table(spark, d, "documents")).select("a", "b", "logprob")
    items = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "swap_last").otherwise("reverse").alias("phenomenon"), t.word_tokens(F.col("text")).alias("w"))
    both = items.select("item_id", "phenomenon", F.explode(F.array(F.struct(F.lit("good").alias("kind"), F.col("w")), F.struct(F.lit("bad").alias("kind"), F.reverse("w").alias("w")))).alias("v"))
    y = both.select("item_id", "phenomenon", "v.kind", F.posexplode_outer("v.w").alias("k", "a"))
    z = y.withColumn("b", F.lead("a").over(Window.partitionBy("item_id", "kind").orderBy("k"))).filter("b is not null")
    s = z.join(model, ["a", "b"], "left").groupBy("item_id", "phenomenon").agg(
        F.avg(F.when(F.col("kind") == "good", -F.coalesce("logprob", F.lit(-12.0)))).alias("good"), F.avg(F.when(F.col("kind") == "bad", -F.coalesce("logprob", F.lit(-12.0)))).alias("bad")
    )
    r = s.rollup("phenomenon").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("good") < F.col("bad")) / F.count("*"), 6).alias("accuracy"))
    return r.withColumn("phenomenon", F.coalesce("phenomenon", F.lit("total")))


def _generations(spark, d):
    return table(spark, d, "conversations").filter("role = 'assistant'")


@query("gen_lengths", rf"SELECT count(*) AS n, round(avg(len({_W})), 6) AS words, round(avg(len(text)), 6) AS chars FROM conversations WHERE role = 'assistant'")
def gen_lengths(spark, d):
    return _generations(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.size(t.blank_words(F.col("text")))), 6).alias("words"), F.round(F.avg(F.char_length("text")), 6).alias("chars"))


_NG = " UNION ALL ".join(
    rf"SELECT {n} AS n, round(count(DISTINCT g) / count(*), 9) AS \"distinct\" FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM w)".replace('\\"', '"')
    for n in (1, 2, 3, 4)
)


@query("distinct_n", f"WITH w AS (SELECT {_W} AS w FROM conversations WHERE role = 'assistant') {_NG}")
def distinct_n(spark, d):
    g = _generations(spark, d)
    parts = [ops.distinct_n(g, "role", n).select("n", "distinct") for n in (1, 2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("repeat_n", f"""
WITH w AS (SELECT {_W} AS w FROM conversations WHERE role = 'assistant'),
g AS (SELECT list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM w),
r AS (SELECT round(1 - len(list_distinct(g)) / len(g), 9) AS r FROM g WHERE len(g) > 0)
SELECT count(*) AS n, round(avg(r), 6) AS repeat_3, round(list_sort(list(r))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1], 6) AS p95 FROM r""")
def repeat_n(spark, d):
    from ..operators.corpus import order_statistics

    r = _generations(spark, d).select("role", F.round(ops.repeat_share(3), 9).alias("r")).filter("r is not null")
    mean = r.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("repeat_3"))
    return mean.join(order_statistics(r, "role", "r", {"p95": ("of_last", 0.95)}), "role").select("n", "repeat_3", F.round("p95", 6).alias("p95"))


@query("repetition_penalty", """
SELECT event_id, round(exp(8.0::DOUBLE * greatest(0.0::DOUBLE, (value % 1) - 0.1::DOUBLE)) + 25.0::DOUBLE * greatest(0.0::DOUBLE, (value * 7 % 1) - 0.5::DOUBLE), 6) AS multiplier,
       CASE WHEN value % 1 >= 0.3 OR value * 7 % 1 >= 0.75 THEN 'fail' WHEN value % 1 >= 0.15 OR value * 7 % 1 > 0.5 THEN 'warn' ELSE 'ok' END AS status FROM events""")
def repetition_penalty(spark, d):
    r, cut = F.col("value") % 1, F.col("value") * 7 % 1
    return table(spark, d, "events").select("event_id", F.round(maths.repetition_multiplier(r, cut), 6).alias("multiplier"), maths.repetition_status(r, cut).alias("status"))


@query("loop_diagnostics")
def loop_diagnostics(spark, d):
    """Shares of texts with loops and of the words in them; rests on suffix_loop, tested there."""
    x = table(spark, d, "documents").select("lang", texts.loop_start("text").alias("x")).select("lang", "x.*")
    gone = F.when(F.col("is_loop"), F.col("words") - F.col("kept")).otherwise(0)
    return x.groupBy("lang").agg(
        F.round(100.0 * F.count_if("is_loop") / F.count("*"), 6).alias("loop_pct"),
        F.round(100.0 * F.count_if(F.col("is_loop") & (gone < 0.5 * F.col("words"))) / F.count("*"), 6).alias("mild_loop_pct"),
        F.round(100.0 * F.try_divide(F.sum(gone), F.sum("words")), 6).alias("loop_text_pct"),
    )


@query("canary_by_group", f"""
WITH it AS (SELECT item_id, w[1:6] AS head, w[7:] AS suf FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) >= 12),
d AS (SELECT doc_id, lang, {_W} AS w FROM documents),
p AS (SELECT doc_id, i, w[i:i + 5] AS head FROM d, unnest(range(1, greatest(len(w) - 4, 1))) t(i)),
h AS (SELECT item_id, d.doc_id, lang, len(suf) AS n, coalesce(list_min(list_filter(range(1, len(suf) + 1), lambda k: suf[k] IS DISTINCT FROM d.w[p.i + 5 + k])) - 1, len(suf)) AS lcp
  FROM p JOIN it USING (head) JOIN d ON d.doc_id = p.doc_id),
per AS (SELECT item_id, lang, count(*) AS repeats, max(lcp / n) AS share, max(CAST(lcp = n AS INTEGER)) AS match FROM h GROUP BY item_id, lang)
SELECT lang, repeats, count(*) AS items, round(100.0::DOUBLE * avg(match), 6) AS accuracy, round(avg(share), 6) AS lcp_share FROM per GROUP BY lang, repeats""")
def canary_by_group(spark, d):
    """By language and number of occurrences: items, matches to the end, mean share of the suffix matched."""
    hits = ops.canaries(table(spark, d, "benchmark"), table(spark, d, "documents"))
    per = hits.groupBy("item_id", "lang").agg(F.count("*").alias("repeats"), F.max(F.col("lcp") / F.col("n")).alias("share"), F.max((F.col("lcp") == F.col("n")).cast("int")).alias("match"))
    return per.groupBy("lang", "repeats").agg(F.count("*").alias("items"), F.round(100.0 * F.avg("match"), 6).alias("accuracy"), F.round(F.avg("share"), 6).alias("lcp_share"))


@query("canary_match", "SELECT a.conv_id, a.turn, left(b.text, len(a.text)) = a.text AS match FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'")
def canary_match(spark, d):
    p = texts.prompt_answers(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", (F.substring("answer", F.lit(1), F.char_length("prompt")) == F.col("prompt")).alias("match"))


@query("benchmark_scores", rf"""
WITH p AS (SELECT item_id, {_W} AS w FROM benchmark),
s AS (SELECT item_id, lower(regexp_replace(trim(w[1], '.,'), '[^\x00-\x7F]', '?', 'g')) AS g, lower(regexp_replace(w[-1], '[^\x00-\x7F]', '?', 'g')) AS t, lower(trim(w[1], '.,')) = lower(w[-1]) AS ok FROM p),
v AS (SELECT item_id, CAST(ok AS INTEGER) AS exact, greatest(0.0::DOUBLE, (1 - levenshtein(g, t) / greatest(len(g), len(t))::DOUBLE) * 100) AS similarity FROM s)
SELECT count(*) AS n, round(avg(exact), 6) AS accuracy, round(avg(similarity), 6) AS similarity, round(avg(CASE WHEN similarity >= 50 THEN similarity ELSE 0 END), 6) AS thresholded FROM v""")
def benchmark_scores(spark, d):
    """The item's own first word stands for what a model has generated."""
    p = texts.prompt_targets(table(spark, d, "benchmark"))
    p = p.select("item_id", "target", F.concat(F.get(t.blank_words(F.col("prompt")), F.lit(0))).alias("generated"), F.lit(-1.0).alias("logprob"))
    s = ops.benchmark_scores(p.withColumn("generated", F.concat(F.lit("<unk> "), "generated")).withColumn("generated", F.regexp_replace("generated", "^<unk> ", "")), ["item_id"])
    return s.agg(F.count("*").alias("n"), F.round(F.avg("exact"), 6).alias("accuracy"), F.round(F.avg("similarity"), 6).alias("similarity"), F.round(F.avg("thresholded"), 6).alias("thresholded"))


@query("external_ppl", """
WITH s AS (SELECT event_type AS model, user_id % 3 AS scorer, avg(value) FILTER (WHERE value < 200) AS ppl FROM events GROUP BY 1, 2)
SELECT model, round(avg(ppl), 6) AS ppl, count(ppl) AS scorers FROM s GROUP BY model""")
def external_ppl(spark, d):
    """Mean over scorers of the mean of each one's finite values; 200 and more stand for infinity."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("scorer")).agg(F.avg(F.when(F.col("value") < 200, F.col("value"))).alias("ppl"))
    return s.groupBy("model").agg(F.round(F.avg("ppl"), 6).alias("ppl"), F.count("ppl").alias("scorers"))


@query("speed_mad", """
WITH m AS (SELECT event_type, median(value) AS med, avg(value) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY event_type),
x AS (SELECT e.event_type, median(abs(value - med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY e.event_type)
SELECT event_type, n, round(med, 6) AS median, round(mad, 6) AS mad, round(mad / med, 6) AS rel_mad, round(mean, 6) AS mean, low, high FROM m JOIN x USING (event_type)""")
def speed_mad(spark, d):
    return ops.speed(table(spark, d, "events"), "event_type", "value")


@query("zip_join", "SELECT a.item_id, a.text AS prompt, b.text AS target FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)")
def zip_join(spark, d):
    """Lists zipped by position are an equi-join on the position."""
    b = table(spark, d, "benchmark")
    n = F.broadcast(b.agg(F.count("*").alias("n")))  # one row
    own = b.crossJoin(n).select("item_id", F.col("text").alias("prompt"), ((F.col("item_id") + 1) % F.col("n")).alias("k"))
    return own.join(b.select(F.col("item_id").alias("k"), F.col("text").alias("target")), "k").select("item_id", "prompt", "target")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]))"


@query("cosine_sim", f"""
WITH b AS (SELECT embedding AS base FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round({_DOT.format("embedding", "base")} / sqrt({_DOT.format("embedding", "embedding")} * {_DOT.format("base", "base")}), 6) AS cosine FROM embeddings, b""")
def cosine_sim(spark, d):
    e = table(spark, d, "embeddings")
    return ops.cosine(e, e.filter("vec_id = 0"))


@query("isotropy", f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_DOT.format("embedding", "embedding")})) AS u FROM embeddings)
SELECT round(avg({_DOT.format("a.u", "b.u")}), 6) AS isotropy FROM u a JOIN u b ON a.vec_id <> b.vec_id""")
def isotropy(spark, d):
    return ops.isotropy(table(spark, d, "embeddings"))


@query("embedding_effective_rank")
def embedding_effective_rank(spark, d):
    """Participation ratio, and dimensions for 90 and 95 percent of the variance."""
    values, n = ops.covariance_spectrum(table(spark, d, "embeddings"), 64)
    total = sum(values)
    run, k = 0.0, {}
    for i, v in enumerate(values, 1):
        run += v
        for share in (0.90, 0.95):
            if run >= share * total and share not in k:
                k[share] = i
    ratio = total**2 / sum(v * v for v in values) if values else None
    return spark.createDataFrame([(n, ratio, k.get(0.90), k.get(0.95))], "n long, participation_ratio double, k90 int, k95 int")


@query("cum_variance_rank", """
WITH v AS (SELECT i, var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY i),
c AS (SELECT v, sum(v) OVER (ORDER BY v DESC, i) AS run, sum(v) OVER () AS total, row_number() OVER (ORDER BY v DESC, i) AS rn FROM v)
SELECT CAST(min(rn) FILTER (WHERE run >= 0.9::DOUBLE * total) AS INTEGER) AS k90, CAST(min(rn) FILTER (WHERE run >= 0.95::DOUBLE * total) AS INTEGER) AS k95 FROM c""")
def cum_variance_rank(spark, d):
    v = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    own = Window.orderBy(F.desc("v"), "i")  # one row per dimension
    c = v.select("v", F.sum("v").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(own).alias("rn")).crossJoin(v.agg(F.sum("v").alias("total")))
    return c.agg(*[F.min(F.when(F.col("run") >= s * F.col("total"), F.col("rn"))).alias(k) for k, s in (("k90", 0.9), ("k95", 0.95))])


@query("softmax_rank", """
WITH l AS (SELECT user_id, event_id, value / 100.0::DOUBLE AS z FROM events),
s AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, event_id) AS rn FROM l)
SELECT user_id, event_id, round(p, 9) AS p FROM s WHERE rn <= 3""")
def softmax_rank(spark, d):
    own = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100.0).alias("z"))
    s = e.select("*", (F.exp("z") / F.sum(F.exp("z")).over(own)).alias("p"), F.row_number().over(own.orderBy(F.desc("z"), "event_id")).alias("rn"))
    return s.filter("rn <= 3").select("user_id", "event_id", F.round("p", 9).alias("p"))


@query("topk_per_group", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 10")
def topk_per_group(spark, d):
    return ops.first_rank(table(spark, d, "events"), ["event_type"], [F.desc("value"), "event_id"], 10).select("event_type", "event_id", "value")


@query("repetition_logits", """
WITH e AS (SELECT event_id, value - 50 AS v, user_id % 4 AS c FROM events)
SELECT event_id, round(CASE WHEN v > 0 THEN v / pow(1.2::DOUBLE, c) ELSE v * pow(1.2::DOUBLE, c) END, 6) AS logit FROM e""")
def repetition_logits(spark, d):
    return table(spark, d, "events").select("event_id", F.round(maths.penalised_logit(F.col("value") - 50, 1.2, F.col("user_id") % 4), 6).alias("logit"))


@query("safe_exp", "SELECT event_id, CASE WHEN value * 10 > 700 THEN 'inf' ELSE CAST(round(exp(value * 0.01), 6) AS VARCHAR) END = 'inf' AS is_inf, round(exp(least(value, 700) * 0.01), 6) AS e FROM events")
def safe_exp(spark, d):
    big = maths.safe_exp(F.col("value") * 10) == float("inf")
    return table(spark, d, "events").select("event_id", big.alias("is_inf"), F.round(maths.safe_exp(F.least("value", F.lit(700)) * 0.01), 6).alias("e"))


@query("canary_budget", rf"""
WITH s AS (SELECT len(array_to_string(w[7:], ' ')) AS chars, len(w[7:]) AS words FROM (SELECT {_W} AS w FROM benchmark) WHERE len(w) >= 12)
SELECT greatest(1, (max(chars) + 10) // 10 * 10, (max(words) + 10) // 10 * 10) AS budget FROM s""")
def canary_budget(spark, d):
    """How many new tokens a canary run may need: the longest suffix in characters and words, rounded up to tens."""
    w = table(spark, d, "benchmark").select(t.blank_words(F.col("text")).alias("w")).filter("size(w) >= 12").select(F.slice("w", F.lit(7), F.size("w")).alias("w"))
    tens = lambda c: F.floor((F.max(c) + 10) / 10) * 10
    return w.agg(F.greatest(F.lit(1), tens(F.char_length(F.array_join("w", " "))), tens(F.size("w"))).cast("long").alias("budget"))


@query("last_word_benchmark", f"""
WITH p AS (SELECT lang, {_W} AS w FROM documents),
s AS (SELECT lang, lower(w[-2]) = lower(w[-1]) AS ok FROM p WHERE len(w) >= 2)
SELECT lang, lang <> 'en' AS skipped, CASE WHEN lang = 'en' THEN count(*) END AS n, CASE WHEN lang = 'en' THEN round(avg(CAST(ok AS INTEGER)), 6) END AS accuracy FROM s GROUP BY lang""")
def last_word_benchmark(spark, d):
    """Only English is scored, other languages are reported as skipped. The word before the last stands for the generation."""
    w = table(spark, d, "documents").select("lang", t.blank_words(F.col("text")).alias("w")).filter("size(w) >= 2")
    ok = F.lower(F.element_at("w", -2)) == F.lower(F.element_at("w", -1))
    g = w.select("lang", ok.cast("int").alias("ok")).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("a"))
    english = F.col("lang") == "en"
    return g.select("lang", (~english).alias("skipped"), F.when(english, F.col("n")).alias("n"), F.when(english, F.col("a")).alias("accuracy"))
