"""Queries over sources, sinks and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as t
from ..operators import corpus as ops
from ..sources import readers
from .registry import query, table

_TOKENS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n'))"
_WORDS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query("tokenizer_profile", rf"""
WITH tok AS (SELECT lang, {_TOKENS} AS token FROM documents),
freq AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token),
vocab AS (SELECT token FROM freq ORDER BY cnt DESC, token LIMIT 996),
chars AS (SELECT lang, sum(len(text)) AS chars FROM documents GROUP BY lang),
stats AS (
  SELECT lang, count(*) AS tokens, count(*) FILTER (WHERE vocab.token IS NULL) AS oov, count(DISTINCT vocab.token) AS used, sum(len(tok.token)) AS token_chars
  FROM tok LEFT JOIN vocab USING (token) GROUP BY lang)
SELECT lang, tokens, CAST(chars AS BIGINT) AS chars, round(chars / tokens, 6) AS compression, round(oov / tokens, 6) AS oov_rate,
       round(used / 1000.0, 6) AS vocab_utilization, round(token_chars / tokens, 6) AS avg_token_length
FROM stats JOIN chars USING (lang)""")
def tokenizer_profile(spark, d):
    return ops.tokenizer_profile(table(spark, d, "documents"), size=1000, specials=4)


@query("scan_text_lines", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)")
def scan_text_lines(spark, d):
    return readers.corpus_lines(table(spark, d, "documents"))


@query("scan_first_column", "SELECT CAST(doc_id AS VARCHAR) AS text FROM documents")
def scan_first_column(spark, d):
    return readers.text_column(table(spark, d, "documents").select("doc_id", "lang"))


@query("scan_limit", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").orderBy("doc_id").limit(100)


@query("count_lines", "SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def count_lines(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query("estimate_rows", """
WITH f AS (SELECT strlen(text) + 1 AS n FROM documents ORDER BY doc_id LIMIT 100)
SELECT count(*) AS sampled, avg(n) AS mean_bytes, CAST(floor((SELECT sum(strlen(text) + 1) FROM documents) / avg(n)) AS BIGINT) AS estimate FROM f""")
def estimate_rows(spark, d):
    return readers.estimated_rows(table(spark, d, "documents"), sample=100)


@query("drop_blank", r"""
SELECT doc_id, pos, line FROM (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g') AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)) WHERE line <> ''""")
def drop_blank(spark, d):
    lines = readers.corpus_lines(table(spark, d, "documents"))
    return lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter(F.col("line") != "")


@query("tsv_parse", r"""
WITH x AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN text ELSE regexp_replace(text, ' ', chr(9), 'g') END AS text FROM benchmark)
SELECT item_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(9))[1] AS prompt, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(9))[2] AS target
FROM x WHERE len(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(9))) >= 2""")
def tsv_parse(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.when(F.col("item_id") % 7 == 0, F.col("text")).otherwise(F.replace("text", F.lit(" "), F.lit("\t"))))
    return readers.tsv_pairs(b).select("item_id", "prompt", "target")


@query("json_lenient", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(props, 3) ELSE props END AS p FROM events)
SELECT event_id, json_extract_string(p, '$.k') AS k FROM x WHERE json_valid(p)""")
def json_lenient(spark, d):
    e = table(spark, d, "events").withColumn("p", F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")))
    return readers.json_rows(e, "k string", "p").select("event_id", F.col("row.k").alias("k"))


@query("json_extract", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def json_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("props").alias("props"))


@query("prompt_half", "SELECT item_id, substring(text, 1, CAST(greatest(1, len(text) // 2) AS INTEGER)) AS prompt FROM benchmark")
def prompt_half(spark, d):
    return table(spark, d, "benchmark").select("item_id", readers.prompt_half(F.col("text")).alias("prompt"))


@query("min_words_filter", f"SELECT doc_id FROM documents WHERE len({_WORDS}) >= 100")
def min_words_filter(spark, d):
    return table(spark, d, "documents").filter(F.size(t.blank_words(F.col("text"))) >= 100).select("doc_id")


@query("char_freq", "SELECT c, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_freq(spark, d):
    return ops.char_counts(table(spark, d, "documents")).select(F.col("token").alias("c"), "cnt")


@query("word_freq", f"SELECT token, count(*) AS cnt FROM (SELECT {_TOKENS} AS token FROM documents) GROUP BY token")
def word_freq(spark, d):
    return ops.word_counts(table(spark, d, "documents"))


@query("byte_freq", "SELECT b, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY b")
def byte_freq(spark, d):
    h = F.hex(F.encode("text", "utf-8"))
    return table(spark, d, "documents").select(F.explode_outer(F.regexp_extract_all(h, F.lit(".."), F.lit(0))).alias("b")).filter("b is not null").groupBy("b").agg(F.count("*").alias("cnt"))


@query("top_k_words", f"SELECT token, count(*) AS cnt FROM (SELECT {_TOKENS} AS token FROM documents) GROUP BY token ORDER BY cnt DESC, token LIMIT 500")
def top_k_words(spark, d):
    return ops.top_tokens(ops.word_counts(table(spark, d, "documents")), 500)


@query("token_len_hist_text", f"SELECT len(token) AS n_chars, count(*) AS cnt FROM (SELECT {_TOKENS} AS token FROM documents) GROUP BY 1")
def token_len_hist_text(spark, d):
    return ops.length_histogram(ops.word_counts(table(spark, d, "documents")), "cnt")


@query("token_len_hist_vocab", f"SELECT len(token) AS n_chars, count(*) AS cnt FROM (SELECT DISTINCT token FROM (SELECT {_TOKENS} AS token FROM documents)) GROUP BY 1")
def token_len_hist_vocab(spark, d):
    return ops.length_histogram(ops.word_counts(table(spark, d, "documents")), None)


@query("len_dist_normalized", f"""
WITH h AS (SELECT len(token) AS n_chars, count(*) AS cnt FROM (SELECT {_TOKENS} AS token FROM documents) WHERE len(token) > 0 GROUP BY 1)
SELECT n_chars, round(cnt / sum(cnt) OVER (), 9) AS share FROM h""")
def len_dist_normalized(spark, d):
    h = ops.length_histogram(ops.word_counts(table(spark, d, "documents")), "cnt").filter("n_chars > 0")
    total = h.agg(F.sum("cnt").alias("total"))  # one row
    return h.crossJoin(F.broadcast(total)).select("n_chars", F.round(F.col("cnt") / F.col("total"), 9).alias("share"))


@query("avg_token_length", f"""
WITH f AS (SELECT token, count(*) AS cnt FROM (SELECT {_TOKENS} AS token FROM documents) GROUP BY token)
SELECT round(avg(len(token)), 6) AS of_types, round(sum(len(token) * cnt) / sum(cnt), 6) AS of_occurrences FROM f""")
def avg_token_length(spark, d):
    f = ops.word_counts(table(spark, d, "documents"))
    n = F.char_length("token")
    return f.agg(F.round(F.avg(n), 6).alias("of_types"), F.round(F.sum(n * F.col("cnt")) / F.sum("cnt"), 6).alias("of_occurrences"))


@query("vocab_utilization", f"""
WITH tok AS (SELECT lang, {_TOKENS} AS token FROM documents),
vocab AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 996)
SELECT lang, round(count(DISTINCT vocab.token) / 1000.0, 6) AS vocab_utilization FROM tok LEFT JOIN vocab USING (token) GROUP BY lang""")
def vocab_utilization(spark, d):
    return ops.tokenizer_profile(table(spark, d, "documents"), 1000, 4).select("lang", "vocab_utilization")


@query("oov_rate", f"""
WITH tok AS (SELECT lang, {_TOKENS} AS token FROM documents),
vocab AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 996)
SELECT lang, round(count(*) FILTER (WHERE vocab.token IS NULL) / count(*), 6) AS oov_rate FROM tok LEFT JOIN vocab USING (token) GROUP BY lang""")
def oov_rate(spark, d):
    return ops.tokenizer_profile(table(spark, d, "documents"), 1000, 4).select("lang", "oov_rate")


@query("compression_ratio", f"""
SELECT lang, round(sum(len(text)) / sum(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]|\\n'))), 6) AS compression FROM documents GROUP BY lang""")
def compression_ratio(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(F.char_length("text")) / F.sum(F.size(t.word_tokens(F.col("text")))), 6).alias("compression"))


@query("length_stats", f"""
WITH n AS (SELECT lang, len({_WORDS}) AS n FROM documents)
SELECT lang, count(*) AS docs, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high,
       list_sort(list(n))[count(*) // 2 + 1] AS median, list_sort(list(n))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95
FROM n GROUP BY lang""")
def length_stats(spark, d):
    n = table(spark, d, "documents").select("lang", F.size(t.blank_words(F.col("text"))).alias("n"))
    return ops.length_stats(n, "lang", "n")


@query("recommended_context", f"""
WITH n AS (SELECT lang, len({_WORDS}) AS n FROM documents)
SELECT lang, CAST(least(512, floor(list_sort(list(n))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] * 1.2::DOUBLE)) AS INTEGER) AS context FROM n GROUP BY lang""")
def recommended_context(spark, d):
    n = table(spark, d, "documents").select("lang", F.size(t.blank_words(F.col("text"))).alias("n"))
    return ops.length_stats(n, "lang", "n").select("lang", F.least(F.lit(512), F.floor(F.col("p95") * 1.2)).cast("int").alias("context"))


@query("histogram_40", """
WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT CAST(least(39, floor((n_chars - lo) * 40.0::DOUBLE / (hi - lo))) AS INTEGER) AS bin, count(*) AS cnt FROM documents, b GROUP BY 1""")
def histogram_40(spark, d):
    docs = table(spark, d, "documents").select("n_chars")
    edges = docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))  # one row
    bin_ = F.least(F.lit(39), F.floor((F.col("n_chars") - F.col("lo")) * 40.0 / (F.col("hi") - F.col("lo")))).cast("int")
    return docs.crossJoin(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("cnt"))


@query("safe_mean", "SELECT event_type, avg(CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 4) END) IS NULL AS missing, round(avg(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END), 6) AS mean FROM events GROUP BY event_type")
def safe_mean(spark, d):
    v = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.avg(v).isNull().alias("missing"), F.round(F.avg(v), 6).alias("mean"))


@query("safe_percentile", """
SELECT event_type, list_sort(list(value))[CAST(round_even(0.95::DOUBLE * (count(value) - 1), 0) AS INTEGER) + 1] AS p95,
       list_sort(list(value))[CAST(round_even(0.5::DOUBLE * (count(value) - 1), 0) AS INTEGER) + 1] AS p50 FROM events GROUP BY event_type""")
def safe_percentile(spark, d):
    return ops.order_statistics(table(spark, d, "events"), "event_type", "value", {"p95": ("nearest", 0.95), "p50": ("nearest", 0.5)})


@query("percentile_flavours", """
SELECT event_type, list_sort(list(value))[CAST(round_even(0.95::DOUBLE * (count(value) - 1), 0) AS INTEGER) + 1] AS nearest,
       list_sort(list(value))[CAST(least(floor(0.95::DOUBLE * count(value)), count(value) - 1) AS INTEGER) + 1] AS of_n,
       list_sort(list(value))[CAST(floor(0.95::DOUBLE * (count(value) - 1)) AS INTEGER) + 1] AS of_last,
       round(quantile_cont(value, 0.95), 6) AS linear, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type""")
def percentile_flavours(spark, d):
    e = table(spark, d, "events")
    ranks = ops.order_statistics(e, "event_type", "value", {"nearest": ("nearest", 0.95), "of_n": ("of_n", 0.95), "of_last": ("of_last", 0.95)})
    between = e.groupBy("event_type").agg(F.round(maths.linear(F.col("value"), 0.95), 6).alias("linear"), F.round(maths.linear(F.col("value"), 0.5), 6).alias("median"))
    return ranks.join(between, "event_type")


@query("clean_lines", r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(j AS INTEGER) AS chunk, substring(line, CAST(j * 200 + 1 AS BIGINT), 200) AS piece FROM (
  SELECT doc_id, i, regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g') AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)), unnest(range(0, (len(line) - 1) // 200 + 1)) u(j) WHERE line <> ''""")
def clean_lines(spark, d):
    return ops.clean_lines(table(spark, d, "documents"), most=200)


@query("subsample_hash", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100) ORDER BY doc_id")
def subsample_hash(spark, d):
    return ops.subsample(table(spark, d, "documents"), "doc_id", 100, 42).select("doc_id")


@query("train_fraction", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT CAST(count(*) * 0.1::DOUBLE AS BIGINT) FROM documents)")
def train_fraction(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.orderBy("doc_id").limit(int(docs.count() * 0.1))


@query("chunked_sort", """
WITH r AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents)
SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY n_chars DESC, doc_id) AS place FROM r""")
def chunked_sort(spark, d):
    return ops.chunked_sort(table(spark, d, "documents"), "doc_id", "n_chars", 64)


@query("length_buckets", f"SELECT len({_WORDS}) AS n_words, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def length_buckets(spark, d):
    return table(spark, d, "documents").groupBy(F.size(t.blank_words(F.col("text"))).alias("n_words")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("dedup_sum", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT DISTINCT ON (md5(text)) md5(text) AS h, n_chars, 'src' || CAST(min(doc_id) OVER (PARTITION BY md5(text)) % 3 AS VARCHAR) AS source FROM documents) GROUP BY source")
def dedup_sum(spark, d):
    once = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"))
    return once.groupBy(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source")).agg(F.sum("n_chars").alias("chars"))
