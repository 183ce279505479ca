"""Tokenizers that can be kept: a learned table that encodes, decodes, is saved and loaded.

A text is cut into chunks that tile it, so that decoding gives it back: a blank with what follows
it (one blank is put before the text), or the usual byte-level chunks. Pieces are found per chunk in
Arrow batches. A codec holds no more than its pieces, merges and scores; saved, these are
Parquet tables beside a JSON line, in any folder that Spark can reach.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from . import subword, vocab
from .corpus import char_counts, top_tokens, word_counts

SPECIALS = vocab.SPECIALS
UNK = vocab.UNK
BLANK_CHUNK = " [^ ]*"
#: Fixed value: the published byte-level chunk pattern.
BYTE_CHUNK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LINE_CHUNK = r"\n| [^ \n]*|[^ \n]+"
LONGEST_UNIGRAM = 16
UNKNOWN_SCORE = -20.0


def _bytes(s: str) -> list[str]:
    """UTF-8 bytes as Latin-1 characters."""
    return list(s.encode().decode("latin-1"))


def _byte_name(b: int) -> str:
    return f"<0x{b:02X}>"


#: Up to so many symbols, looking through all pairs for each merge is faster than a heap.
SHORT = 24


def _merged_short(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    s, never = list(symbols), len(rank)
    ranks = [rank.get(p, never) for p in zip(s, s[1:], strict=False)]
    while ranks and (least := min(ranks)) < never:
        i = ranks.index(least)
        s[i : i + 2] = [s[i] + s[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get((s[i - 1], s[i]), never)
        if i < len(ranks):
            ranks[i] = rank.get((s[i], s[i + 1]), never)
    return s


def merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The lowest-ranked pair first, the leftmost of equals, until none is left; n log n in the symbols."""
    if len(symbols) <= SHORT:
        return _merged_short(symbols, rank)
    s: list[str | None] = list(symbols)
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if j >= n or s[i] != left or s[j] != right:
            continue
        s[i], s[j], after[i] = left + right, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (p := (s[a], s[b])) in rank:
                heapq.heappush(heap, (rank[p], a, p))
    return [x for x in s if x is not None]


@dataclass(frozen=True)
class Codec:
    """kind names the rule; pieces are in the order of their ids, special ones first."""

    kind: str
    pieces: tuple[str, ...]
    merges: tuple[tuple[str, str], ...] = ()
    scores: tuple[float, ...] = ()

    def ids(self) -> dict[str, int]:
        """Ids of pieces; a learned piece that spells a special one keeps its own id."""
        return {p: i for i, p in enumerate(self.pieces) if i >= len(SPECIALS)}

    def coder(self) -> Callable[[str], list[int]]:
        """The encoding function of one text, with tables of its own."""
        return _RULES[self.kind][0](self)

    def tokens(self, text: str) -> list[str]:
        return [self.pieces[i] for i in self.coder()(text)]

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        kept = [i for i in ids if 0 <= i < len(self.pieces) and not (skip_special and i < len(SPECIALS))]
        return _RULES[self.kind][1]([self.pieces[i] for i in kept])

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, ids. A missing text has no ids."""
        if self.kind in _BY_CHUNK:
            return subword.encode_chunks(docs, lambda: _BY_CHUNK[self.kind](self), key, text)
        return subword.encode(docs, self.coder, key, text)

    def decoded(self, rows: DataFrame, key: str = "doc_id", ids: str = "ids", skip_special: bool = True) -> DataFrame:
        """key, text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spelled = _SPELLED[self.kind](self.pieces, skip_special) if self.kind in _SPELLED else None
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    b = batch.slice(a, 1000)
                    texts = spelled(b.column(1)) if spelled else pa.array([self.decode(x.as_py() or [], skip_special) for x in b.column(1)], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0), texts], [key, "text"])

        return rows.select(key, ids).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text string")

    def save(self, spark: SparkSession, path: str) -> None:
        scores = self.scores or (None,) * len(self.pieces)
        rows = [(i, p, s) for i, (p, s) in enumerate(zip(self.pieces, scores, strict=True))]
        spark.createDataFrame(rows, "id int, token string, score double").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        pairs = [(i, a, b) for i, (a, b) in enumerate(self.merges)]
        spark.createDataFrame(pairs, "rank int, a string, b string").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        config = [(self.kind, len(self.pieces), list(SPECIALS))]
        spark.createDataFrame(config, "type string, vocab_size int, special_tokens array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codec:
        config = spark.read.json(f"{path}/config").first()
        rows = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
        pairs = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        if config is None or config.vocab_size != len(rows):
            raise ValueError(f"{path} does not hold a whole codec")
        scores = tuple(r.score for r in rows)
        return Codec(config.type, tuple(r.token for r in rows), tuple((r.a, r.b) for r in pairs), () if None in scores else scores)


# ---------------------------------------------------------------- encoding and decoding rules


Chunked = tuple[Callable[[str], list[str]], Callable[[str], list[int]]]


def _coder(by_chunk: Callable[[Codec], Chunked]) -> Callable[[Codec], Callable[[str], list[int]]]:
    """The encoding function of one text, of the chunks of a text and the ids of a chunk."""

    def make(c: Codec) -> Callable[[str], list[int]]:
        chunks, code = by_chunk(c)
        one = subword._cached(code)
        return lambda x: [i for w in chunks(x) for i in one(w)]

    return make


def _by_merges(c: Codec, chunks: Callable[[str], list[str]], split: Callable[[str], list[str]]) -> Chunked:
    of, rank = c.ids(), {}
    for i, m in enumerate(c.merges):
        rank.setdefault(m, i)
    return chunks, lambda w: [of.get(p, UNK) for p in merged(split(w), rank)]


def _blank_chunks(x: str) -> list[str]:
    return [" " + p for p in x.split(" ")] if x else []


def _line_chunks(x: str) -> list[str]:
    """Line ends by themselves; a blank before every line's first word."""
    x = unicodedata.normalize("NFC", x)
    lines = x.split("\n") if x else []
    out: list[str] = []
    for i, line in enumerate(lines):
        if i:
            out.append("\n")
        if line:
            out += [" " + p for p in line.split(" ")]
    return out


def _wordpiece(c: Codec) -> Chunked:
    of = c.ids()
    # Per first character the lengths of the pieces that begin so, the longest first; apart for the beginning of a word and its rest.
    begins, rest = of, {p[2:]: i for p, i in of.items() if p.startswith("##") and len(p) > 2}
    lengths = [{k: sorted({len(p) for p in pieces if p[:1] == k}, reverse=True) for k in {p[0] for p in pieces if p}} for pieces in (begins, rest)]

    def match(w: str) -> list[int]:
        out, at, n, pieces, by_first = [], 0, len(w), begins, lengths[0]
        while at < n:
            for k in by_first.get(w[at], ()):
                if (i := pieces.get(w[at : at + k])) is not None and at + k <= n:
                    break
            else:
                return [UNK]
            out.append(i)
            at += k
            pieces, by_first = rest, lengths[1]
        return out

    return _line_chunks, match


def _unjoined(pieces: list[str]) -> str:
    """Word pieces as text: continuations lose their mark, lines the blank before their first word."""
    lines = "".join(p[2:] if p.startswith("##") and len(p) > 2 else p for p in pieces).split("\n")
    return "\n".join(x[1:] if x.startswith(" ") else x for x in lines)


def _unigram(c: Codec) -> Chunked:
    of = c.ids()
    score = {p: s for p, s in zip(c.pieces[len(SPECIALS) + 256 :], c.scores[len(SPECIALS) + 256 :], strict=True)}
    trie = subword.Trie(score)

    def code(w: str) -> list[int]:
        out: list[int] = []
        for p in subword.best_pieces(w, trie, score, UNKNOWN_SCORE):
            out += [of[p]] if p in score else [len(SPECIALS) + b for b in p.encode()]
        return out

    return _blank_chunks, code


_BYTE_VALUES = {_byte_name(b): b for b in range(256)}


def _unbyted(pieces: list[str]) -> str:
    """Pieces and byte pieces; the blank before the text goes."""
    raw = b"".join(bytes([_BYTE_VALUES[p]]) if p in _BYTE_VALUES else p.encode() for p in pieces)
    return raw.decode("utf-8", "replace")[1:]


def _words(c: Codec) -> Callable[[str], list[int]]:
    of = c.ids()
    return lambda x: [of.get(w, UNK) for w in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\n", x.lower())]


def _unworded(pieces: list[str]) -> str:
    return " ".join(pieces).replace(" .", ".").replace(" ,", ",").replace(" \n", "\n")


def _chars(c: Codec) -> Callable[[str], list[int]]:
    of = c.ids()
    return lambda x: [of.get(ch, UNK) for ch in unicodedata.normalize("NFC", x)]


def _longest(c: Codec) -> Callable[[str], list[int]]:
    of = c.ids()
    trie = subword.Trie(of)
    return lambda x: [of[p] if p else UNK for p in subword.longest_match(x.lower(), trie)]


def _speller(of: Callable[[str], bytes], ended: Callable[[pa.Array], pa.Array] = lambda x: x):
    """Texts of lists of ids, from the bytes of each piece; ended: what decoding does at last."""

    def make(pieces: tuple[str, ...], skip_special: bool) -> Callable[[pa.Array], pa.Array]:
        table = pa.array([*(b"" if skip_special and i < len(SPECIALS) else of(p) for i, p in enumerate(pieces)), b""], pa.large_binary())

        def run(ids: pa.Array) -> pa.Array:
            rows = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
            flat = pc.fill_null(ids.flatten(), -1).to_numpy()
            parts = table.take(pa.array(np.where((flat >= 0) & (flat < len(pieces)), flat, len(pieces))))
            offsets = np.frombuffer(parts.buffers()[1], np.int64)[rows] if len(flat) else np.zeros(len(rows), np.int64)
            raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), parts.buffers()[2] or pa.py_buffer(b"")])
            try:
                texts = raw.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
            return ended(texts)

        return run

    return make


def _without_first(texts: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(texts, 1)


def _without_line_blanks(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\n ", "\n")
    return pc.if_else(pc.starts_with(texts, " "), _without_first(texts), texts)


_SPELLED = {
    "char_level": _speller(str.encode),
    "bpe": _speller(str.encode, _without_first),
    "byte_bpe": _speller(lambda p: p.encode("latin-1")),
    "wordpiece": _speller(lambda p: (p[2:] if p.startswith("##") and len(p) > 2 else p).encode(), _without_line_blanks),
    "unigram": _speller(lambda p: bytes([_BYTE_VALUES[p]]) if p in _BYTE_VALUES else p.encode(), _without_first),
    "morpheme": _speller(str.encode),
}

_BY_CHUNK: dict[str, Callable[[Codec], Chunked]] = {
    "bpe": lambda c: _by_merges(c, _blank_chunks, list),
    "byte_bpe": lambda c: _by_merges(c, regex.compile(BYTE_CHUNK).findall, _bytes),
    "wordpiece": _wordpiece,
    "unigram": _unigram,
}

_RULES: dict[str, tuple[Callable[[Codec], Callable[[str], list[int]]], Callable[[list[str]], str]]] = {
    "char_level": (_chars, "".join),
    "word_level": (_words, _unworded),
    "bpe": (_coder(_BY_CHUNK["bpe"]), lambda p: "".join(p)[1:]),
    "byte_bpe": (_coder(_BY_CHUNK["byte_bpe"]), lambda p: "".join(p).encode("latin-1").decode("utf-8", "replace")),
    "wordpiece": (_coder(_BY_CHUNK["wordpiece"]), _unjoined),
    "unigram": (_coder(_BY_CHUNK["unigram"]), _unbyted),
    "morpheme": (_longest, "".join),
}


# ---------------------------------------------------------------- training


def chunk_counts(docs: DataFrame, chunks: Column) -> DataFrame:
    """token, cnt of chunks."""
    return docs.select(F.explode_outer(chunks).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


def _blank_chunk_counts(docs: DataFrame) -> DataFrame:
    x = F.regexp_extract_all(F.concat(F.lit(" "), F.col("text")), F.lit(BLANK_CHUNK), F.lit(0))
    return chunk_counts(docs.filter("text <> ''"), x)


def train_bpe(docs: DataFrame, size: int) -> Codec:
    base, merges = subword.learn(_blank_chunk_counts(docs), size - len(SPECIALS))
    return Codec("bpe", (*SPECIALS, *dict.fromkeys([*base, *(a + b for a, b in merges)])), tuple(merges))


def train_byte_bpe(docs: DataFrame, size: int) -> Codec:
    counts = chunk_counts(docs, F.regexp_extract_all(F.col("text"), F.lit("(?U)" + BYTE_CHUNK), F.lit(0)))
    base, merges = subword.learn(counts, size - len(SPECIALS), _bytes, alphabet=[chr(b) for b in range(256)])
    return Codec("byte_bpe", (*SPECIALS, *dict.fromkeys([*base, *(a + b for a, b in merges)])), tuple(merges))


def train_wordpiece(docs: DataFrame, size: int) -> Codec:
    lines = docs.select(F.explode_outer(F.split(t.nfc(F.col("text")), "\n", -1)).alias("text")).filter("text <> ''")
    base, merges = subword.learn(_blank_chunk_counts(lines), size - len(SPECIALS) - 1, lambda w: [w[:1], *("##" + c for c in w[1:])])
    pieces = dict.fromkeys(["\n", *base])
    spelled = {p: p for p in base}
    for a, b in merges:
        spelled.setdefault(a + b, spelled[a] + spelled[b].removeprefix("##"))
        pieces[spelled[a + b]] = None
    return Codec("wordpiece", (*SPECIALS, *pieces))


def train_unigram(docs: DataFrame, size: int, rounds: int = 4) -> Codec:
    """Seeds, best segmentations and their counts are DataFrames over chunk types; the driver holds pieces only.

    Characters are kept up to a coverage of 0.9998 of all; rarer ones become bytes. Pieces have at most 16 characters.
    """
    counts = _blank_chunk_counts(docs).persist()
    try:
        return _unigram_of(counts, docs, size - len(SPECIALS) - 256, rounds)
    finally:
        counts.unpersist()


def _unigram_of(counts: DataFrame, docs: DataFrame, size: int, rounds: int) -> Codec:
    ranked = char_counts(docs).orderBy(F.desc("cnt"), "token").collect()  # an alphabet
    wanted, run, chars = 0.9998 * sum(r.cnt for r in ranked), 0, {" "}
    for r in ranked:
        if run >= wanted:
            break
        run += r.cnt
        chars.add(r.token)
    n = F.char_length("token")
    starts = counts.select("token", "cnt", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_UNIGRAM), n - F.col("i") + 1))
    seeds = starts.select("cnt", F.explode(F.transform(lengths, lambda k: F.substring("token", F.col("i"), k))).alias("piece")).groupBy("piece").agg(F.sum("cnt").alias("n"))
    best = seeds.orderBy(F.desc(F.col("n") * F.char_length("piece")), "piece").limit(4 * max(size, 1)).collect()
    freq = {r.piece: r.n for r in best if set(r.piece) <= chars and r.piece not in _BYTE_VALUES}
    of_char = {r.token: r.cnt for r in ranked}
    for c in chars:
        freq.setdefault(c, of_char.get(c, 1))
    total = sum(freq.values())
    score = {p: math.log(v / total) for p, v in freq.items()}
    for _ in range(rounds):
        used = _used(counts, score)
        total = sum(used.values()) + len(chars)
        aim = max(size, len(score) * 3 // 4)
        order = sorted(used, key=lambda p: (-used[p], p))
        kept = chars | set(order[: max(0, aim - len(chars))])
        score = {p: math.log((used.get(p, 0) + (p in chars)) / total) for p in kept if used.get(p) or p in chars}
    order = sorted(score, key=lambda p: (p not in chars, -score[p], p))[: max(size, len(chars))]
    names = [_byte_name(b) for b in range(256)]
    return Codec("unigram", (*SPECIALS, *names, *order), (), (*[0.0] * (len(SPECIALS) + 256), *(score[p] for p in order)))


def _used(counts: DataFrame, score: dict[str, float]) -> dict[str, int]:
    """How often each piece stands in the best segmentations: counted per batch, summed by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = subword.Trie(score)
        for b in batches:
            own: dict[str, int] = {}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in subword.best_pieces(w, trie, score, UNKNOWN_SCORE):
                    if p in score:
                        own[p] = own.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["piece", "n"])

    rows = counts.select("token", "cnt").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in rows.collect()}  # at most the pieces of the score


def train_morpheme(docs: DataFrame, size: int, lexicon: DataFrame | None = None) -> Codec:
    """The alphabet and the most frequent pieces, of lower-cased words with the blank before them.

    A lexicon (word, morphemes) splits the words it knows; the first morpheme keeps the blank.
    """
    pieces = chunk_counts(docs, t.merged_pieces(F.col("text")))
    if lexicon is not None:
        known = lexicon.select(F.lower("word").alias("w"), F.col("morphemes").alias("m")).filter("size(m) > 0").dropDuplicates(["w"])
        word = F.when(F.col("token").startswith(" ") & (F.char_length("token") > 1), F.substring("token", 2, 1 << 30)).otherwise(F.col("token"))
        both = pieces.withColumn("w", word).join(known, "w", "left")
        blank = F.substring("token", F.lit(1), F.char_length("token") - F.char_length("w"))
        first = F.concat(blank, F.lower(F.element_at("m", 1)))
        rest = F.transform(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))), F.lower)
        parts = F.when(F.col("m").isNull(), F.array("token")).otherwise(F.concat(F.array(first), rest))
        pieces = both.select("cnt", F.explode(parts).alias("token")).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    chars = [r.token for r in char_counts(docs.select(F.lower("text").alias("text"))).select("token").orderBy("token").collect()]  # an alphabet
    top = [r.token for r in top_tokens(pieces, max(size - len(SPECIALS), 1)).collect()]
    return Codec("morpheme", (*SPECIALS, *list(dict.fromkeys([*chars, *top]))[: max(size - len(SPECIALS), len(chars))]))


def train_words(docs: DataFrame, size: int) -> Codec:
    rows = top_tokens(word_counts(docs), size - len(SPECIALS)).collect()
    return Codec("word_level", (*SPECIALS, *(r.token for r in rows)))


def train_chars(docs: DataFrame, size: int) -> Codec:
    rows = vocab.char_vocab(docs.select(t.nfc(F.col("text")).alias("text")), size).orderBy("id").collect()
    return Codec("char_level", tuple(r.token for r in rows))


TRAINERS: dict[str, Callable[[DataFrame, int], Codec]] = {
    "char_level": train_chars,
    "word_level": train_words,
    "bpe": train_bpe,
    "byte_bpe": train_byte_bpe,
    "wordpiece": train_wordpiece,
    "unigram": train_unigram,
    "morpheme": train_morpheme,
}


def train(kind: str, docs: DataFrame, size: int) -> Codec:
    if kind not in TRAINERS:
        raise ValueError(f"no tokenizer {kind!r}; there are {', '.join(TRAINERS)}")
    return TRAINERS[kind](docs, size)


def surfaces(text: str, pieces: list[str]) -> list[str]:
    """Pieces of the lower-cased text as they are written in the text; as they are where they do not tile it."""
    low = text.lower()
    if len(low) != len(text) or "" in pieces or "".join(pieces) != low:
        return list(pieces)
    rest = iter(text)
    return ["".join(next(rest) for _ in p) for p in pieces]
