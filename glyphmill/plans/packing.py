"""Queries over packing, sharding and shuffling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import packing as ops
from ..operators import vocab
from ..sources.readers import corpus_lines
from .registry import query, table

_N = r"len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.size(t.blank_words(F.col("text"))).alias("n"))


@query("pack_tokens", f"""
WITH RECURSIVE w AS (SELECT source, CAST({_N} AS INTEGER) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, 0 AS n, 0 AS used, CAST(0 AS BIGINT) AS sample, 0 AS had, CAST(0 AS BIGINT) AS began FROM w
  UNION ALL
  SELECT w.source, w.rn, w.n, CASE WHEN f.used + w.n <= 256 THEN f.used + w.n ELSE CAST(w.n - 256 * ((w.n - 1) // 256) AS INTEGER) END,
         f.sample + CASE WHEN f.used + w.n <= 256 THEN 0 ELSE CAST(f.used > 0 AS INTEGER) + (w.n - 1) // 256 END, f.used, f.sample
  FROM f JOIN w ON w.source = f.source AND w.rn = f.rn + 1)
SELECT source, sample AS sample_id, CAST(max(used) AS INTEGER) AS used FROM f WHERE used > 0 GROUP BY source, sample
UNION ALL
SELECT source, began + CAST(had > 0 AS INTEGER) + unnest(range(0, (n - 1) // 256)) AS sample_id, 256 AS used FROM f WHERE n > 256""")
def pack_tokens(spark, d):
    """Documents into samples of 256, longer ones cut; tokens are ones, padding zeros, so used counts them."""
    lines = _words(spark, d).withColumn("ids", F.array_repeat(F.lit(1), F.col("n")))
    packed = ops.pack_tokens(lines, "source", ["doc_id"], 256, 0, frozenset())
    return packed.select("source", "sample_id", F.size(F.filter("input_ids", lambda x: x != 0)).alias("used"))


@query("pack_lazy")
def pack_lazy(spark, d):
    """Lines of text into samples of 510 characters; tested against a plain fold."""
    lines = corpus_lines(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ops.pack_lazy(lines, "source", ["doc_id", "pos"], 512)


@query("pack_per_line", """
WITH l AS (SELECT doc_id, CAST(unnest(range(0, (greatest(len(text), 1) - 1) // 512 + 1)) AS INTEGER) AS piece, text FROM documents)
SELECT doc_id, piece, substring(text, piece * 512 + 1, 512) AS text, len(substring(text, piece * 512 + 1, 512)) AS length FROM l""")
def pack_per_line(spark, d):
    """Rows are cut on their own: nothing crosses a document, so nothing is shuffled."""
    docs = table(spark, d, "documents")
    p = docs.select("doc_id", F.posexplode_outer(t.slot_chunks(F.col("text"), 512)).alias("piece", "text"))
    return p.select("doc_id", "piece", "text", F.char_length("text").cast("long").alias("length"))


@query("global_shuffle", """
WITH h AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, CAST(('0x' || substring(h, 1, 8)) AS BIGINT) % 16 AS bucket, row_number() OVER (PARTITION BY CAST(('0x' || substring(h, 1, 8)) AS BIGINT) % 16 ORDER BY h, doc_id) AS place FROM h""")
def global_shuffle(spark, d):
    return ops.shuffled(table(spark, d, "documents"), "doc_id", 42, 16)


@query("shard_manifest", "SELECT doc_id // 64 AS shard, count(*) AS samples, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def shard_manifest(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("shard")).agg(F.count("*").alias("samples"), F.sum("n_chars").alias("chars"))


@query("shard_offsets", """
WITH s AS (SELECT doc_id // 64 AS shard, count(*) AS samples FROM documents GROUP BY 1)
SELECT shard, samples, CAST(coalesce(sum(samples) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""")
def shard_offsets(spark, d):
    return ops.shard_sizes(table(spark, d, "documents").withColumn("shard", F.floor(F.col("doc_id") / 64)), "shard")


@query("shard_lookup", """
WITH s AS (SELECT doc_id // 64 AS shard, count(*) AS samples FROM documents GROUP BY 1),
o AS (SELECT shard, samples, coalesce(sum(samples) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
w AS (SELECT item_id * 17 % (SELECT count(*) FROM documents) AS idx FROM benchmark)
SELECT idx, shard, CAST(idx - off AS BIGINT) AS place FROM w JOIN o ON idx >= off AND idx < off + samples""")
def shard_lookup(spark, d):
    """Global row numbers to shards: a range join with the catalogue, one row per shard."""
    docs = table(spark, d, "documents")
    o = ops.shard_sizes(docs.withColumn("shard", F.floor(F.col("doc_id") / 64)), "shard")
    total = docs.agg(F.count("*").alias("total"))  # one row
    w = table(spark, d, "benchmark").crossJoin(F.broadcast(total)).select((F.col("item_id") * 17 % F.col("total")).alias("idx"))
    j = w.join(o, (F.col("idx") >= F.col("offset")) & (F.col("idx") < F.col("offset") + F.col("samples")))
    return j.select("idx", "shard", (F.col("idx") - F.col("offset")).alias("place"))


@query("context_budget", f"SELECT lang, greatest(1, 2048 - max({_N})) AS max_new FROM documents GROUP BY lang")
def context_budget(spark, d):
    n = F.size(t.blank_words(F.col("text")))
    return table(spark, d, "documents").groupBy("lang").agg(F.greatest(F.lit(1), 2048 - F.max(n)).cast("long").alias("max_new"))


@query("keep_latest", "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def keep_latest(spark, d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return table(spark, d, "documents").select("source", "doc_id", rn.alias("rn")).filter("rn = 1").drop("rn")


@query("pick_latest", """
WITH f AS (SELECT source, 'step_' || CAST(doc_id AS VARCHAR) AS name, doc_id FROM documents UNION ALL SELECT DISTINCT source, 'best_model', NULL FROM documents WHERE source IN ('src1', 'src2'))
SELECT source, arg_max(name, CASE WHEN name = 'best_model' THEN 9223372036854775807 ELSE doc_id END) AS name FROM f GROUP BY source""")
def pick_latest(spark, d):
    docs = table(spark, d, "documents")
    named = docs.filter(F.col("source").isin("src1", "src2")).select("source", F.lit("best_model").alias("name")).distinct()
    files = docs.select("source", F.concat(F.lit("step_"), F.col("doc_id").cast("string")).alias("name")).unionByName(named)
    step = F.regexp_extract("name", r"^step_(\d+)$", 1)
    rank = F.when(F.col("name") == "best_model", F.lit(2**63 - 1)).otherwise(step.try_cast("long"))
    return files.groupBy("source").agg(F.max_by("name", rank).alias("name"))


@query("slot_token_length", r"""
WITH s AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\s*\S+|\s+$'), lambda w:
  string_split(regexp_replace(w, '([.,!?/:;)\]}])(\p{L})', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS slots FROM documents)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(slots, lambda w: (greatest(len(w), 1) - 1) // 24 + 1)), 0) AS BIGINT) AS n FROM s""")
def slot_token_length(spark, d):
    """Slots of a text: the chunks of at most 24 characters of its words; what packing by slots counts."""
    return table(spark, d, "documents").select("doc_id", t.slot_length(F.col("text"), 24).alias("n"))


@query("plain_text_dataset", r"""
WITH freq AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n')) AS token FROM documents) GROUP BY token),
top AS (SELECT token, cnt FROM freq ORDER BY cnt DESC, token LIMIT 496),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS INTEGER) AS id FROM top),
l AS (SELECT doc_id, k - 1 AS pos, trim(string_split(text, chr(10))[k], ' ' || chr(9) || chr(13)) AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(k)),
w AS (SELECT doc_id || ':' || pos AS line, regexp_extract_all(lower(line), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n') AS w FROM l WHERE line <> ''),
x AS (SELECT line, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM w)
SELECT line, list_prepend(2, list_append(list(coalesce(id, 0) ORDER BY i), 3))[1:32] AS ids FROM x LEFT JOIN vocab USING (token) GROUP BY line""")
def plain_text_dataset(spark, d):
    """Stripped lines that are not blank, as ids with their edges, 32 at most (the length of an example is the feature)."""
    docs = table(spark, d, "documents")
    lines = corpus_lines(docs).select(F.concat_ws(":", "doc_id", "pos").alias("line"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    coded = vocab.code_arrays(lines, t.word_tokens(F.col("text")), vocab.word_vocab(docs, 500), key="line", edges=(vocab.BOS, vocab.EOS))
    return coded.filter(F.size("ids") > 2).select("line", F.slice("ids", 1, 32).alias("ids"))
