"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import texts as ops
from .registry import query, table

_WORDS = r"list_filter(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_OWN = _WORDS.format("text")
_EDGES = "'" + t.EDGES.replace("'", "''") + "'"
_FOLD = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"
#: User turns with the answer that follows.
_PAIRS = "SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'"


def _pairs(spark, d):
    return ops.prompt_answers(table(spark, d, "conversations"))


@query("nfc_text", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.nfc("text").alias("text"))


@query("word_tokens", r"SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n') AS tokens FROM benchmark")
def word_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.word_tokens(F.col("text")).alias("tokens"))


@query("slot_segment", r"""
SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\s*\S+|\s+$'), lambda w:
  string_split(regexp_replace(w, '([.,!?/:;)\]}])(\p{L})', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS slots FROM documents""")
def slot_segment(spark, d):
    return table(spark, d, "documents").select("doc_id", t.slot_segments(F.col("text")).alias("slots"))


@query("slot_chunks", f"""
SELECT item_id, w, list_transform(range(0, (greatest(len(w), 1) - 1) // 4 + 1), lambda i: substring(w, i * 4 + 1, 4)) AS chunks
FROM (SELECT item_id, unnest({_OWN}) AS w FROM benchmark)""")
def slot_chunks(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode_outer(t.blank_words(F.col("text"))).alias("w")).filter("w is not null")
    return w.select("item_id", "w", t.slot_chunks(F.col("w"), 4).alias("chunks"))


@query("morph_words", r"SELECT doc_id, regexp_extract_all(lower(text), '\n| |[!-/:-@\[-`{-~]|[0-9]|[^\n !-/:-@\[-`{-~0-9]+') AS words FROM documents")
def morph_words(spark, d):
    return table(spark, d, "documents").select("doc_id", t.morph_words(F.col("text")).alias("words"))


@query("merge_space", r"""
WITH RECURSIVE p AS (SELECT item_id, regexp_extract_all(lower(text), '\n| |[!-/:-@\[-`{-~]|[0-9]|[^\n !-/:-@\[-`{-~0-9]+') AS w FROM benchmark),
m AS (
  SELECT item_id, w, 1 AS i, CAST([] AS VARCHAR[]) AS merged FROM p
  UNION ALL
  SELECT item_id, w, CASE WHEN w[i] = ' ' AND i < len(w) THEN i + 2 ELSE i + 1 END,
         list_append(merged, CASE WHEN w[i] = ' ' AND i < len(w) THEN ' ' || w[i + 1] ELSE w[i] END)
  FROM m WHERE i <= len(w))
SELECT item_id, merged FROM m WHERE i > len(w)""")
def merge_space(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.merged_pieces(F.col("text")).alias("merged"))


@query("edge_strip", f"SELECT item_id, list_transform({_OWN}, lambda w: trim(w, {_EDGES})) AS words FROM benchmark")
def edge_strip(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.transform(t.blank_words(F.col("text")), t.edge_strip).alias("words"))


@query("lev_similarity", f"""
WITH p AS ({_PAIRS}), x AS (SELECT conv_id, turn, {_FOLD.format("prompt")} AS a, {_FOLD.format("answer")} AS b FROM p)
SELECT conv_id, turn, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, (1 - levenshtein(a, b) / greatest(len(a), len(b))::DOUBLE) * 100) END, 6) AS similarity FROM x""")
def lev_similarity(spark, d):
    similarity = t.similarity_percent(t.ascii_fold(F.col("prompt")), t.ascii_fold(F.col("answer")))
    return _pairs(spark, d).select("conv_id", "turn", F.round(similarity, 6).alias("similarity"))


@query("lev_threshold", f"""
WITH p AS ({_PAIRS}), x AS (SELECT conv_id, turn, {_FOLD.format("prompt")} AS a, {_FOLD.format("answer")} AS b FROM p),
s AS (SELECT conv_id, turn, CASE WHEN greatest(len(a), len(b)) = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, (1 - levenshtein(a, b) / greatest(len(a), len(b))::DOUBLE) * 100) END AS s FROM x)
SELECT conv_id, turn, round(CASE WHEN s >= 20 THEN s ELSE 0 END, 6) AS score FROM s""")
def lev_threshold(spark, d):
    similarity = t.similarity_percent(t.ascii_fold(F.col("prompt")), t.ascii_fold(F.col("answer")))
    return _pairs(spark, d).select("conv_id", "turn", F.round(t.cutoff(similarity, 20.0), 6).alias("score"))


@query("word_levenshtein")
def word_levenshtein(spark, d):
    """Edit distance of word lists: Arrow, tested against the definition."""
    return _pairs(spark, d).select("conv_id", "turn", ops.word_distance(F.col("prompt"), F.col("answer")).alias("distance"))


_SKIP = "(" + ", ".join(f"'{w}'" for w in t.SKIPPED_WORDS) + ")"


@query("first_content_word", rf"""
WITH c AS (SELECT item_id, text, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(text, '^\s+', ''), chr(10))[1:3], lambda l: {_WORDS.format("l")})),
  lambda w: trim(w, {_EDGES})), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS w FROM (SELECT doc_id AS item_id, text FROM documents)),
b AS (SELECT item_id, text, w, CASE WHEN len(w[1]) = 1 AND regexp_matches(w[1], '^\p{{L}}$') THEN coalesce(list_filter(range(2, len(w) + 1), lambda i: len(w[i]) >= 3)[1], 1) ELSE 1 END AS i FROM c),
g AS (SELECT item_id, text, w, i, list_filter(w[i:], lambda x: lower(x) NOT IN {_SKIP} AND lower(x) NOT IN ('<unk>', '[unk]')) AS good FROM b)
SELECT item_id AS doc_id, CASE WHEN len(w) = 0 THEN regexp_extract(text, '[\p{{L}}\p{{N}}_]+') WHEN len(good) > 0 THEN good[1]
  WHEN lower(w[i]) IN ('<unk>', '[unk]') THEN '' ELSE w[i] END AS word FROM g""")
def first_content_word(spark, d):
    return table(spark, d, "documents").select("doc_id", t.first_content_word(F.col("text")).alias("word"))


@query("lcp_len", "WITH p AS (SELECT a.item_id AS x, b.item_id AS y, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id > a.item_id AND left(a.text, 2) = left(b.text, 2)) SELECT x, y, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: left(a, i) = left(b, i))) AS lcp FROM p")
def lcp_len(spark, d):
    b = table(spark, d, "benchmark")
    own = b.select(F.col("item_id").alias("x"), F.col("text").alias("a"), F.substring("text", 1, 2).alias("k"))
    other = b.select(F.col("item_id").alias("y"), F.col("text").alias("b"), F.substring("text", 1, 2).alias("k"))
    return own.join(other, (own.k == other.k) & (F.col("y") > F.col("x"))).select("x", "y", t.common_prefix(F.col("a"), F.col("b")).cast("long").alias("lcp"))


@query("ngrams", f"SELECT item_id, list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS grams FROM (SELECT item_id, {_OWN} AS w FROM benchmark)")
def ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.ngrams(t.blank_words(F.col("text")), 3).alias("grams"))


@query("quality_flag", r"""
SELECT doc_id, CASE WHEN contains(text, chr(65533)) THEN 'replacement_char_U+FFFD'
  WHEN len(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 60 THEN 'too_short(len=' || len(regexp_replace(text, '^\s+|\s+$', '', 'g')) || '<60)'
  WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04FF}a-zA-Z]')) < 100 THEN 'too_few_letters(' || len(regexp_extract_all(text, '[\x{0400}-\x{04FF}a-zA-Z]')) || '<100)' END AS flag FROM documents""")
def quality_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", t.quality_flag(F.col("text"), 60, 100).alias("flag"))


@query("mojibake_flag", "SELECT doc_id, regexp_matches(text, '[ÐÑРСЃЌўџ]') AS mangled FROM documents")
def mojibake_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", t.looks_mangled(F.col("text")).alias("mangled"))


@query("mojibake_repair", "SELECT doc_id, text FROM documents")
def mojibake_repair(spark, d):
    """A code-page accident and its repair give the text back."""
    return table(spark, d, "documents").select("doc_id", t.unmangle(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("text"))


def _literal(s: str) -> str:
    """A DuckDB string, line ends as chr()."""
    told = "'" + s.replace("'", "''") + "'"
    return told.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")


def _sql_replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_literal(a)}, {_literal(b)})"
    return x


@query("tex_escape", f"SELECT doc_id, {_sql_replaced('text', t.LABEL_ESCAPES)} AS label, {_sql_replaced('text', t.BODY_ESCAPES)} AS body FROM documents")
def tex_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", t.tex_label(F.col("text")).alias("label"), t.tex_body(F.col("text")).alias("body"))


@query("truncate_ellipsis", "SELECT doc_id, CASE WHEN len(text) > 150 THEN left(text, 150) || '...' ELSE text END AS text FROM documents")
def truncate_ellipsis(spark, d):
    return table(spark, d, "documents").select("doc_id", t.ellipsis(F.col("text")).alias("text"))


_JOINED = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n'), ' ')"


@query("detokenize_words", f"SELECT item_id, {_sql_replaced(_JOINED, ((' .', '.'), (' ,', ','), (chr(32) + chr(10), chr(10))))} AS text FROM benchmark")
def detokenize_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.detokenize(t.word_tokens(F.col("text"))).alias("text"))


@query("join_prompt_target", f"""
WITH w AS (SELECT item_id, {_OWN} AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) < 2 THEN array_to_string(w, ' ') ELSE array_to_string(w[:-2], ' ') || ' ' || w[-1] END AS joined FROM w""")
def join_prompt_target(spark, d):
    p = ops.prompt_targets(table(spark, d, "benchmark"))
    return p.select("item_id", t.join_prompt(F.concat("prompt", F.lit("  ")), F.concat(F.lit(" "), "target")).alias("joined"))


@query("continuation_text", "SELECT doc_id, substring(text, 41, len(text)) AS rest FROM documents")
def continuation_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.continuation(F.col("text"), F.substring("text", 1, 40)).alias("rest"))


@query("escape_newlines", r"SELECT doc_id, replace(text, chr(10), '\n') AS text FROM documents")
def escape_newlines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("text"))


@query("truncate_head", "SELECT doc_id, left(text, 100) AS text FROM documents")
def truncate_head(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("text"))


@query("first_k_words", f"SELECT doc_id, array_to_string(({_OWN})[1:5], ' ') AS prompt FROM documents")
def first_k_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(t.blank_words(F.col("text")), 1, 5), " ").alias("prompt"))


@query("finite_filter", "SELECT doc_id, try_cast(regexp_extract(text, '[0-9]+') AS DOUBLE) AS v FROM documents WHERE try_cast(regexp_extract(text, '[0-9]+') AS DOUBLE) IS NOT NULL")
def finite_filter(spark, d):
    v = ops.finite(F.regexp_extract("text", "[0-9]+", 0))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).filter("v is not null")


@query("pct_normalize", "SELECT event_id, CASE WHEN value <= 1 THEN value * 100 ELSE value END AS pct FROM events")
def pct_normalize(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")).alias("pct"))


_GRAMS = f"""
w AS (SELECT conv_id, turn, text, {_OWN} AS w FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, turn, i, array_to_string(w[i:i + 1], ' ') AS gram, len(w) AS n FROM w, unnest(range(1, greatest(len(w) - 1, 0) + 1)) t(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, gram ORDER BY i) AS seen FROM g)"""


@query("trim_repeats", f"""
WITH {_GRAMS}, f AS (SELECT conv_id, turn, min(i - 1) AS keep FROM c WHERE seen > 2 AND i - 1 + 2 >= 8 GROUP BY conv_id, turn)
SELECT w.conv_id, w.turn, CASE WHEN keep >= 8 THEN array_to_string(w[1:keep], ' ') ELSE w.text END AS text, coalesce(keep >= 8, false) AS trimmed
FROM w LEFT JOIN f USING (conv_id, turn)""")
def trim_repeats(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return ops.trimmed(c, ["conv_id", "turn"], n=2, most=2, least_words=8)


@query("suffix_loop")
def suffix_loop(spark, d):
    """Texts that end in a loop, and how many words come before it: Arrow, tested against the definition."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ops.loop_start("text").alias("x")).select("doc_id", "x.is_loop", "x.words", "x.kept")


@query("ordered_distinct", f"SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT item_id, {_OWN} AS w FROM benchmark)")
def ordered_distinct(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_distinct(t.blank_words(F.col("text"))).alias("words"))
