"""Vocabulary builders and lookups, as DataFrames of token and id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .corpus import char_counts, vocabulary, word_counts

SPECIALS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]")
UNK, PAD, BOS, EOS = 0, 1, 2, 3
#: Characters that a character vocabulary always has, and the letters of a slot alphabet.
FORCED = ("й", "Й", "ё", "Ё")
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
END_OF_WORD = "<eow>"
#: A vocabulary up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: An alphabet has no more rows than Unicode has code points.
CODE_POINTS = 1_114_112


def word_vocab(docs: DataFrame, size: int) -> DataFrame:
    return vocabulary(word_counts(docs), size, SPECIALS)


def char_vocab(docs: DataFrame, size: int, least: int = 1) -> DataFrame:
    """Characters of least occurrences or more, forced ones first where the size cuts."""
    counts = char_counts(docs).filter(F.col("cnt") >= least)
    spark = docs.sparkSession
    forced = spark.createDataFrame([(c,) for c in FORCED], "token string")
    both = counts.unionByName(forced.select("token", F.lit(0).cast("long").alias("cnt"))).groupBy("token").agg(F.max("cnt").alias("cnt"))
    kept = both.orderBy(F.col("token").isin(*FORCED).desc(), F.desc("cnt"), "token").limit(size - len(SPECIALS))
    ranked = kept.select("token", (F.row_number().over(Window.orderBy(F.desc("cnt"), "token")) + len(SPECIALS) - 1).alias("id"))
    return spark.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "token string, id int").unionByName(ranked)


def slot_alphabet(docs: DataFrame, least: int, specials: tuple[str, ...] = ("<pad>", "<unk>", "<bos>", "<eos>")) -> DataFrame:
    """token, id of word-slot characters: frequent ones, Cyrillic letters, the characters of the specials and the specials, in order; padding is 0."""
    spark = docs.sparkSession
    fixed = sorted({*CYRILLIC, *"".join(specials), *specials[1:], END_OF_WORD})
    chars = char_counts(docs).filter(F.col("cnt") >= least).select("token")
    rest = chars.unionByName(spark.createDataFrame([(c,) for c in fixed], "token string")).distinct()
    ranked = rest.select("token", F.row_number().over(Window.orderBy("token")).alias("id"))  # an alphabet: a few thousand rows
    return spark.createDataFrame([(specials[0], 0)], "token string, id int").unionByName(ranked)


def first_seen(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters numbered by where they first appear, after four specials."""
    at = docs.select(key, F.posexplode_outer(F.split("text", "")).alias("pos", "token")).filter("token <> ''")
    first = at.groupBy("token").agg(F.min(F.struct(key, "pos")).alias("at"))
    return first.select("token", (F.row_number().over(Window.orderBy("at")) + 3).alias("id"))  # an alphabet


def _small(vocab: DataFrame, most: int | None) -> DataFrame:
    """Broadcast if it has at most so many rows by construction (most), else by count."""
    return F.broadcast(vocab) if (vocab.count() if most is None else most) <= BROADCAST_ROWS else vocab


def encode(tokens: DataFrame, vocab: DataFrame, keys: list[str], unk: int = UNK, most: int | None = None) -> DataFrame:
    """keys, pos, token, id of rows (keys, pos, token): a lookup, the unknown id elsewhere."""
    return tokens.join(_small(vocab, most), "token", "left").select(*keys, "pos", "token", F.coalesce("id", F.lit(unk)).alias("id"))


def code_arrays(docs: DataFrame, tokens: Column, vocab: DataFrame, key: str = "doc_id", unk: int = UNK, edges: tuple[int, ...] = ()) -> DataFrame:
    """key, ids: token arrays looked up as they lie, by one call per batch; nothing is shuffled. The vocabulary travels in the task.

    edges: nothing, or the ids before and after each row.
    """
    rows = vocab.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("too many tokens to travel in a task; use encode(), which joins")
    names, ids = [r.token for r in rows], np.array([r.id for r in rows] + [unk], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(names, pa.string())
        for b in batches:
            lists = b.column(1)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), len(names)).to_numpy()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(size)
            coded = ids[found]
            if edges:
                coded = np.insert(np.insert(coded, ends, edges[1]), ends - size + np.arange(len(size)), edges[0])
                ends = ends + 2 * np.arange(1, len(size) + 1)
            out = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(coded, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], [key, "ids"])

    return docs.select(key, tokens.alias("_t")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def in_order(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """One array per key, by pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias(name))


def exploded(docs: DataFrame, tokens, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode_outer(tokens).alias("pos", "token")).filter("token is not null and token <> ''")


def decode(ids: DataFrame, vocab: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, pos, token of rows (keys, pos, id), special tokens dropped."""
    return ids.join(_small(vocab, most), "id", "left").filter(~F.coalesce(F.col("token").isin(*SPECIALS), F.lit(False))).select(*keys, "pos", "token")


def slot_ids(docs: DataFrame, alphabet: DataFrame, most: int = 24, key: str = "doc_id") -> DataFrame:
    """key, slots: a list of character ids per word chunk, an end-of-word id after the last chunk of a word.

    The alphabet is a few thousand rows; as a broadcast map it needs no join per character.
    """
    words = docs.select(key, F.posexplode_outer(t.slot_segments(F.col("text"))).alias("w", "word")).filter("word is not null")
    chunks = words.select(key, "w", F.size(t.slot_chunks(F.col("word"), most)).alias("n"), F.posexplode_outer(t.slot_chunks(F.col("word"), most)).alias("c", "chunk"))
    chars = F.concat(F.array_remove(F.split("chunk", ""), ""), F.when(F.col("c") == F.col("n") - 1, F.array(F.lit(END_OF_WORD))).otherwise(F.array().cast("array<string>")))
    rows = chunks.select(key, "w", "c", F.posexplode_outer(chars).alias("pos", "token"))
    coded = encode(rows.filter("token is not null"), alphabet, [key, "w", "c"], most=CODE_POINTS)
    return in_order(in_order(coded, [key, "w", "c"], "id", "ids").select(key, F.struct("w", "c").alias("pos"), "ids"), [key], "ids", "slots")
