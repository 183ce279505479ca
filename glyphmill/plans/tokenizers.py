"""Queries over the tokenizer family: vocabularies, encoding, decoding, subwords."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import codec, corpus, subword, vocab
from .registry import query, table

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n')"
_WORD_VOCAB = rf"""
freq AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token),
top AS (SELECT token, cnt FROM freq ORDER BY cnt DESC, token LIMIT 496),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS INTEGER) AS id FROM top
  UNION ALL SELECT unnest(['[UNK]', '[PAD]', '[CLS]', '[SEP]']), unnest([0, 1, 2, 3]))"""
_MATERIAL = "WITH " + _WORD_VOCAB.replace("freq AS (", "freq AS MATERIALIZED (", 1).replace("vocab AS (", "vocab AS MATERIALIZED (", 1)
_CHAR_VOCAB = """
chars AS (SELECT c AS token, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c HAVING count(*) >= 2),
alls AS (SELECT token, max(cnt) AS cnt FROM (SELECT * FROM chars UNION ALL SELECT unnest(['й', 'Й', 'ё', 'Ё']), 0) GROUP BY token),
kept AS (SELECT token, cnt FROM alls ORDER BY token IN ('й', 'Й', 'ё', 'Ё') DESC, cnt DESC, token LIMIT 60),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS INTEGER) AS id FROM kept
  UNION ALL SELECT unnest(['[UNK]', '[PAD]', '[CLS]', '[SEP]']), unnest([0, 1, 2, 3]))"""


@query("word_vocab", f"WITH {_WORD_VOCAB} SELECT token, id FROM vocab")
def word_vocab(spark, d):
    return vocab.word_vocab(table(spark, d, "documents"), 500)


@query("char_vocab", f"WITH {_CHAR_VOCAB} SELECT token, id FROM vocab")
def char_vocab(spark, d):
    return vocab.char_vocab(table(spark, d, "documents"), 64, least=2)


@query("alphabet_union", """
WITH chars AS (SELECT c AS token FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c HAVING count(*) >= 5),
fixed AS (SELECT unnest(string_split('абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ<pad><unk><bos><eos>', '')) AS token
  UNION SELECT unnest(['<unk>', '<bos>', '<eos>', '<eow>']))
SELECT token, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS id FROM (SELECT token FROM chars UNION SELECT token FROM fixed) UNION ALL SELECT '<pad>', 0""")
def alphabet_union(spark, d):
    return vocab.slot_alphabet(table(spark, d, "documents"), 5)


@query("first_seen_ids", """
WITH places AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS w FROM documents))
SELECT token, CAST(row_number() OVER (ORDER BY min(struct_pack(doc_id := doc_id, i := i))) + 3 AS INTEGER) AS id FROM places WHERE token <> '' GROUP BY token""")
def first_seen_ids(spark, d):
    return vocab.first_seen(table(spark, d, "documents"))


@query("sentence_end_ids", f"WITH {_WORD_VOCAB} SELECT token, id FROM vocab WHERE token IN ('.', '!', '?', chr(10), '。', '！', '？')")
def sentence_end_ids(spark, d):
    return vocab.word_vocab(table(spark, d, "documents"), 500).filter(F.col("token").isin(*t.SENTENCE_ENDS))


@query("encode_word", rf"""
WITH {_WORD_VOCAB}, x AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))
SELECT doc_id, list_prepend(2, list_append(list(coalesce(id, 0) ORDER BY i), 3)) AS ids FROM x LEFT JOIN vocab USING (token) GROUP BY doc_id""")
def encode_word(spark, d):
    docs = table(spark, d, "documents")
    coded = vocab.code_arrays(docs, t.word_tokens(F.col("text")), vocab.word_vocab(docs, 500), edges=(vocab.BOS, vocab.EOS))
    return coded.filter(F.size("ids") > 2)


@query("encode_word_ids", rf"""
WITH {_WORD_VOCAB}, x AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, token, coalesce(id, 0) AS id FROM x LEFT JOIN vocab USING (token)""")
def encode_word_ids(spark, d):
    docs = table(spark, d, "documents")
    return vocab.encode(vocab.exploded(docs, t.word_tokens(F.col("text"))), vocab.word_vocab(docs, 500), ["doc_id"], most=500)


@query("decode_word_ids", rf"""
WITH {_WORD_VOCAB}, x AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))
SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS text FROM x JOIN vocab USING (token) GROUP BY doc_id""")
def decode_word_ids(spark, d):
    docs = table(spark, d, "documents")
    v = vocab.word_vocab(docs, 500)
    coded = vocab.encode(vocab.exploded(docs, t.word_tokens(F.col("text"))), v, ["doc_id"], most=500).drop("token")
    return vocab.in_order(vocab.decode(coded, v, ["doc_id"], most=500), ["doc_id"], "token", "t").select("doc_id", F.array_join("t", " ").alias("text"))


@query("oov_tokens_anti", _MATERIAL + " SELECT token, cnt FROM freq ANTI JOIN (SELECT DISTINCT token FROM vocab) v USING (token)")
def oov_tokens_anti(spark, d):
    docs = table(spark, d, "documents")
    return corpus.word_counts(docs).join(vocab.word_vocab(docs, 500), "token", "left_anti")


@query("encode_char", f"""
WITH {_CHAR_VOCAB}, x AS (SELECT item_id, i, string_split(text, '')[i] AS token FROM benchmark, unnest(range(1, len(text) + 1)) t(i))
SELECT item_id, list(coalesce(id, 0) ORDER BY i) AS ids FROM x LEFT JOIN vocab USING (token) WHERE x.token <> '' GROUP BY item_id""")
def encode_char(spark, d):
    v = vocab.char_vocab(table(spark, d, "documents"), 64, least=2)
    rows = vocab.exploded(table(spark, d, "benchmark"), F.split("text", ""), "item_id")
    return vocab.in_order(vocab.encode(rows, v, ["item_id"], most=64), ["item_id"], "id", "ids")


@query("slot_encode", r"""
WITH chars AS (SELECT c AS token FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c HAVING count(*) >= 5),
fixed AS (SELECT unnest(string_split('абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ<pad><unk><bos><eos>', '')) AS token
  UNION SELECT unnest(['<unk>', '<bos>', '<eos>', '<eow>'])),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS id FROM (SELECT token FROM chars UNION SELECT token FROM fixed)),
s AS (SELECT item_id, flatten(list_transform(regexp_extract_all(text, '\s*\S+|\s+$'), lambda w:
  string_split(regexp_replace(w, '([.,!?/:;)\]}])(\p{L})', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS slots FROM benchmark),
w AS (SELECT item_id, k AS w, slots[k] AS word FROM s, unnest(range(1, len(slots) + 1)) t(k)),
c AS (SELECT item_id, w, j AS c, substring(word, j * 24 + 1, 24) AS chunk, j = (greatest(len(word), 1) - 1) // 24 AS fin FROM w, unnest(range(0, (greatest(len(word), 1) - 1) // 24 + 1)) t(j)),
x AS (SELECT item_id, w, c, i, list_concat(list_filter(string_split(chunk, ''), lambda y: y <> ''), CASE WHEN fin THEN ['<eow>'] ELSE [] END)[i] AS token
  FROM c, unnest(range(1, len(chunk) + CASE WHEN fin THEN 2 ELSE 1 END)) t(i)),
g AS (SELECT item_id, w, c, list(coalesce(id, 0) ORDER BY i) AS ids FROM x LEFT JOIN vocab USING (token) GROUP BY item_id, w, c)
SELECT item_id, list(ids ORDER BY w, c) AS slots FROM g GROUP BY item_id""")
def slot_encode(spark, d):
    alphabet = vocab.slot_alphabet(table(spark, d, "documents"), 5)
    return vocab.slot_ids(table(spark, d, "benchmark"), alphabet, 24, "item_id")


@query("bpe_pair_counts", rf"""
WITH f AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token)
SELECT token[i] AS a, token[i + 1] AS b, CAST(sum(cnt) AS BIGINT) AS cnt FROM f, unnest(range(1, len(token))) t(i) GROUP BY 1, 2""")
def bpe_pair_counts(spark, d):
    return subword.pair_counts(table(spark, d, "documents"))


_SIZE = 600


def _coded(spark, d, kind):
    docs = table(spark, d, "documents")
    coded = codec.train(kind, docs, _SIZE).encode(docs)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("digest"))


def _round_trip(spark, d, kind):
    docs = table(spark, d, "documents")
    c = codec.train(kind, docs, _SIZE)
    return c.decoded(c.encode(docs))


@query("bpe_encode")
def bpe_encode(spark, d):
    return _coded(spark, d, "bpe")


@query("byte_bpe_encode")
def byte_bpe_encode(spark, d):
    return _coded(spark, d, "byte_bpe")


@query("wordpiece_encode")
def wordpiece_encode(spark, d):
    return _coded(spark, d, "wordpiece")


@query("unigram_encode")
def unigram_encode(spark, d):
    return _coded(spark, d, "unigram")


@query("bpe_roundtrip", "SELECT doc_id, text FROM documents")
def bpe_roundtrip(spark, d):
    """Encoding and decoding give every text back, blanks and line ends included."""
    return _round_trip(spark, d, "bpe")


@query("byte_bpe_roundtrip", "SELECT doc_id, text FROM documents")
def byte_bpe_roundtrip(spark, d):
    return _round_trip(spark, d, "byte_bpe")


@query("wordpiece_roundtrip", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def wordpiece_roundtrip(spark, d):
    return _round_trip(spark, d, "wordpiece")


@query("unigram_roundtrip", "SELECT doc_id, text FROM documents")
def unigram_roundtrip(spark, d):
    """Characters beyond the coverage come back from their bytes."""
    return _round_trip(spark, d, "unigram")


@query("morpheme_roundtrip", "SELECT doc_id, lower(text) AS text FROM documents")
def morpheme_roundtrip(spark, d):
    return _round_trip(spark, d, "morpheme")


@query("word_detokenized", f"""
WITH {_WORD_VOCAB.replace("LIMIT 496", "LIMIT 596")}, x AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
k AS (SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS s FROM x JOIN (SELECT token FROM top) USING (token) GROUP BY doc_id)
SELECT doc_id, replace(replace(replace(coalesce(s, ''), ' .', '.'), ' ,', ','), ' ' || chr(10), chr(10)) AS text FROM documents LEFT JOIN k USING (doc_id)""")
def word_detokenized(spark, d):
    """Known words only: an unknown one is a special token, which decoding drops."""
    return _round_trip(spark, d, "word_level")


@query("surface_pieces", r"""
WITH p AS (SELECT item_id, text, regexp_extract_all(lower(text), '\n| |[!-/:-@\[-`{-~]|[0-9]|[^\n !-/:-@\[-`{-~0-9]+') AS p FROM benchmark),
x AS (SELECT item_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
o AS (SELECT *, coalesce(sum(len(piece)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM x)
SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, CAST(before_ AS BIGINT) AS start, piece, substring(text, CAST(before_ AS BIGINT) + 1, len(piece)) AS surface FROM o""")
def surface_pieces(spark, d):
    """Pieces of the lower-cased text, where they begin and how the text writes them."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.posexplode_outer(t.morph_words(F.col("text"))).alias("pos", "piece")).filter("piece is not null")
    own = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(own), F.lit(0))
    return items.select("item_id", "pos", start.alias("start"), "piece", F.substring("text", (start + 1).cast("int"), F.char_length("piece")).alias("surface"))


_PIECES = """
pieces AS (SELECT p AS token, CAST(row_number() OVER (ORDER BY count(*) DESC, p) AS INTEGER) AS id FROM (
  SELECT unnest(list_concat(list_filter(string_split(lower(text), ''), lambda c: c <> ''), string_split(lower(text), ' '))) AS p FROM benchmark) WHERE p <> '' GROUP BY p ORDER BY count(*) DESC, p LIMIT 300)"""


@query("greedy_longest_match", f"""
WITH RECURSIVE {_PIECES},
best AS (
  SELECT item_id, p, coalesce(arg_max(id, len(token)), 0) AS id, coalesce(max(len(token)), 1) AS n
  FROM (SELECT item_id, lower(text) AS s, p FROM benchmark, unnest(range(1, len(text) + 1)) t(p)) x LEFT JOIN pieces ON starts_with(substring(s, p, 128), token) GROUP BY item_id, p),
r AS (
  SELECT item_id, CAST(1 AS BIGINT) AS p, 0 AS k FROM benchmark
  UNION ALL
  SELECT r.item_id, r.p + b.n, r.k + 1 FROM r JOIN best b ON b.item_id = r.item_id AND b.p = r.p)
SELECT r.item_id, list(b.id ORDER BY r.k) AS ids FROM r JOIN best b ON b.item_id = r.item_id AND b.p = r.p GROUP BY r.item_id""")
def greedy_longest_match(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("text"))
    both = F.concat(F.split("text", ""), F.split("text", " "))
    counts = items.select(F.explode_outer(both).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))
    pieces = {r.token: i + 1 for i, r in enumerate(corpus.top_tokens(counts, 300).collect())}
    return subword.encode(items, subword.longest_matcher(pieces), "item_id")


@query("morpheme_encode")
def morpheme_encode(spark, d):
    """Pieces between blanks, symbols and digits, blanks joined to the next one, greedily matched."""
    return _coded(spark, d, "morpheme")


def _spans(spark, d, cut):
    """Boundary probabilities are an input column; here a hash of place and text stands for a model's output."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    chars = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)))
    items = items.withColumn("p", F.transform(chars, lambda i: F.pmod(F.xxhash64("text", i), F.lit(1000)) / 1000.0))
    words = items.select(F.explode_outer(t.blank_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))
    pieces = {r.token: i for i, r in enumerate(corpus.top_tokens(words.filter("token is not null"), 500).collect())}

    def run(batches):
        import pyarrow as pa

        trie = subword.Trie(pieces)
        for b in batches:
            spans = [cut(x or "", p or [], trie) for x, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32())))], ["item_id", "spans"])

    return items.mapInArrow(run, "item_id long, spans array<array<int>>")


@query("viterbi_segment")
def viterbi_segment(spark, d):
    return _spans(spark, d, subword.viterbi_spans)


@query("segment_tokens")
def segment_tokens(spark, d):
    """Hard boundaries at probabilities above 0.8; pieces do not cross them. Tested on worked examples."""
    return _spans(spark, d, lambda x, p, trie: subword.segment_spans(x, [v > 0.8 for v in p], trie))


@query("roundtrip_check", """
SELECT doc_id, len(text) AS chars, trim(regexp_replace(text, '\\s+', ' ', 'g')) = text AS exact FROM documents""")
def roundtrip_check(spark, d):
    """Text rebuilt from its blank-separated words, compared with the text."""
    rebuilt = F.array_join(t.blank_words(F.col("text")), " ")
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), (rebuilt == F.col("text")).alias("exact"))
