"""Benchmark decontamination by winnowing, in DataFrame operations only.

A winnowed fingerprint is the smallest k-gram hash of each run of w k-grams. Any span of
k + w - 1 = 13 shared words holds the same smallest k-gram on both sides, so a join on
fingerprints finds every shared window; each hit is then extended word by word, which also
removes hash collisions. Items of fewer than 13 words are one window: all grams of their
length are fingerprints on both sides.

One pass over the corpus, no shuffle of texts: fingerprints are exploded and probed against the
broadcast benchmark within one stage, and only narrow hit rows leave it. Of documents with a
hit the text is taken again, and each hit with the few words around it that an extension can
reach is compared with the benchmark's. Documents are told apart by id
and hash of the text, never by their place in a scan, so a table that is read again (after a
lost executor, or for another block of the benchmark) gives the same keys; rows that repeat
share one result. Gram hashes and window minima come from doubling (two neighbours make one of
twice the length), so both cost a few steps a word whatever the lengths.
explode_outer rather than explode: for the latter the optimizer infers a filter on the size
of the array, which computes all fingerprints again, and window by window.
The broadcast is bounded: larger benchmarks are probed in blocks of BLOCK_ROWS fingerprints.
Equal passages of many items are one class in it; their ids are attached to what was hit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spool, ascii_lower, only, sifted

WINDOW, K = 13, 6
W = WINDOW - K + 1
BLOCK_ROWS = 200_000
_POS = 28
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _at(fp: Column) -> Column:
    return fp.bitwiseAND((1 << _POS) - 1).cast("int")


def words_of(text: Column) -> Column:
    """ASCII letters (lowered), digits and everything beyond ASCII make words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _later(c: str, k: int) -> Column:
    """The array without its first k entries."""
    return F.slice(F.col(c), k + 1, F.greatest(F.size(c), F.lit(1)))


def _first(c: str, n: Column) -> Column:
    return F.when(n > 0, F.slice(F.col(c), 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def _pairs(a: str, b: Column) -> Column:
    return F.zip_with(F.col(a), b, lambda x, y: F.xxhash64(x, y))


def _placed(length: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.shiftleft(F.xxhash64(x, F.lit(length)), _POS).bitwiseOR(i.cast("long"))


def _packed(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds _v{length}: hash << 28 | position of each gram of that length; empty where the text is shorter."""
    df = df.withColumn("_g1", F.transform(words, lambda x: F.xxhash64(x)))
    for p in (2, 4, 8):
        if p <= max(lengths):
            df = df.withColumn(f"_g{p}", _pairs(f"_g{p // 2}", _later(f"_g{p // 2}", p // 2)))
    for length in lengths:
        sizes = [p for p in (8, 4, 2, 1) if length & p]
        df, done = df.withColumn("_h", F.col(f"_g{sizes[0]}")), sizes[0]
        for p in sizes[1:]:
            df, done = df.withColumn("_h", _pairs("_h", _later(f"_g{p}", done))), done + p
        df = df.withColumn("_h", _first("_h", F.size(words) - length + 1))
        df = df.withColumn(f"_v{length}", F.transform("_h", _placed(length))).drop("_h")
    return df.drop("_g1", "_g2", "_g4", "_g8")


def _winnowed(df: DataFrame, words: str, out: str, lengths: list[int]) -> DataFrame:
    """Adds the fingerprints whose K-gram is the leftmost smallest of some window, and those of all grams of the lengths."""
    df = _packed(df, words, sorted({K, *lengths})).withColumn("_low", F.col(f"_v{K}"))
    for reach in (1, 2, 4):
        df = df.withColumn("_low", F.zip_with("_low", _later("_low", reach), lambda x, y: F.least(x, y)))
    assert W == 8
    df = df.withColumn("_low", F.array_distinct(_first("_low", F.size(words) - WINDOW + 1)))
    return df.withColumn(out, F.concat("_low", *[F.col(f"_v{n}") for n in lengths])).drop("_low", *[f"_v{n}" for n in {K, *lengths}])


def _fingerprints(benchmark: DataFrame) -> DataFrame:
    """h, item, m (words of its window), q (place in ctx), ctx (the words around): a row per fingerprint."""
    items = benchmark.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    long = _winnowed(items.filter(F.size("words") >= WINDOW), "words", "fps", [])
    short = items.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    rows = long.select("item", "words", F.explode_outer("fps").alias("fp"))
    for length in sorted(r[0] for r in short.select(F.size("words")).distinct().collect()):  # at most 12 values
        own = _packed(short.filter(F.size("words") == length), "words", [length])
        rows = rows.unionByName(own.select("item", "words", F.explode_outer(f"_v{length}").alias("fp")))
    rows = rows.filter(F.col("fp").isNotNull())
    at = _at(F.col("fp"))
    first = F.greatest(at - (WINDOW - K), F.lit(0))
    return rows.select(
        F.shiftright("fp", _POS).alias("h"), "item", F.least(F.size("words"), F.lit(WINDOW)).alias("m"), (at - first).alias("q"),
        F.slice("words", first + 1, 2 * WINDOW - K).alias("ctx"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids as strings), contaminated.

    Null and empty texts have no words; null ids stay null; a null item id counts as ''.
    Repeated rows each give their row, and equal ids with other texts are documents of their
    own. An empty benchmark gives zero hits, an empty corpus no rows. Other columns are not
    read. contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "fingerprints")
    fps = _fingerprints(only(benchmark, item=item_col, text=item_text_col))
    fps = spool.put(fps.withColumn("c", F.xxhash64("h", "m", "q", "ctx")), "items")
    classes = spool.put(fps.groupBy("c", "h", "m", "q", "ctx").agg(F.lit(0).alias("_")).drop("_"), "classes")
    short = sorted(r[0] for r in classes.filter(F.col("m") < WINDOW).select("m").distinct().collect())  # at most 12 values
    blocks = max(1, -(-classes.count() // BLOCK_ROWS))
    members = fps.select("c", "item").distinct()
    members = F.broadcast(members) if fps.count() <= BLOCK_ROWS else spool.put(members, "members")
    # One fingerprint that every document has keeps documents without hits in the inner join.
    keeper = spark.range(1).select(F.lit(None).cast("long").alias("c"), F.lit(0).cast("long").alias("h"))
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = d.select("doc_id", "th", words_of(F.col("text")).alias("words"))
    rows = _winnowed(rows, "words", "fps", short).withColumn("fps", F.concat(F.array(F.lit(0).cast("long")), "fps"))
    rows = rows.select("doc_id", "th", F.size("words").alias("n"), F.explode_outer("fps").alias("fp"))
    found, parts = [], []
    for b in range(blocks):
        own = classes if blocks == 1 else classes.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
        probe = own.select("c", "h").groupBy("h").agg(F.min("c").alias("c"))
        probe = (probe if b else probe.unionByName(keeper)).withColumnRenamed("h", "ph")
        j = rows.join(F.broadcast(probe), F.shiftright("fp", _POS) == F.col("ph"))
        found.append(j.select("doc_id", "th", "n", F.when(F.col("c").isNotNull(), F.col("fp")).alias("fp")))
        parts.append(own)
    found = spool.put(reduce(DataFrame.unionByName, found), "found")
    hits = found.filter(F.col("fp").isNotNull()).groupBy("doc_id", "th", "n").agg(F.collect_set("fp").alias("fps"))
    hits = spool.put(hits.select(F.xxhash64("doc_id", "th").alias("rk"), "th", "n", "fps"), "hits")
    again = d.select("doc_id", "th", "text", F.xxhash64("doc_id", "th").alias("rk")).join(hits.filter("n > 0"), ["rk", "th"])
    again = again.select("doc_id", "th", "n", words_of(F.col("text")).alias("words"), "fps")
    around = lambda fp: F.struct(fp.alias("fp"), F.slice("words", F.greatest(_at(fp) - (WINDOW - K), F.lit(0)) + 1, 2 * WINDOW - K).alias("own"))
    again = again.select("doc_id", "th", "n", F.explode_outer(F.transform("fps", around)).alias("f")).select("doc_id", "th", "n", "f.fp", "f.own")
    with sifted(spark):  # few documents have a hit
        if blocks > 1:
            again = spool.put(again, "around")
        matched = spool.put(reduce(DataFrame.unionByName, [_matched(again, F.broadcast(own)) for own in parts]), "matched")
    return _scored(found.filter(F.col("fp").isNull()).drop("fp"), matched, members)


def _matched(rows: DataFrame, block: DataFrame) -> DataFrame:
    """doc_id, th, n, c, span of hits that hold word by word."""
    j = rows.join(block, F.shiftright("fp", _POS) == F.col("h"))
    p = _at(F.col("fp"))
    q = F.least(p, F.lit(WINDOW - K))  # its place in own
    same = lambda i: F.coalesce(F.get("own", q + i) == F.get("ctx", F.col("q") + i), F.lit(False))
    left = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW - K)), F.lit(0), lambda a, i: F.when((a == i - 1) & same(-i), i).otherwise(a))
    right = F.aggregate(F.sequence(F.lit(0), F.lit(WINDOW - 1)), F.lit(0), lambda a, i: F.when((a == i) & same(i), i + 1).otherwise(a))
    j = j.select("doc_id", "th", "n", "c", "m", p.alias("p"), left.alias("a"), right.alias("r")).filter(F.col("a") + F.col("r") >= F.col("m"))
    return j.select("doc_id", "th", "n", "c", F.struct((F.col("p") - F.col("a")).alias("b"), (F.col("p") + F.col("r")).alias("e")).alias("span"))


def _scored(rows: DataFrame, matched: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each of rows (doc_id, th, n), by what of it matched."""
    both = rows.select("*", F.lit(None).cast("long").alias("c"), F.lit(None).cast(matched.schema["span"].dataType).alias("span")).unionByName(matched)
    g = both.groupBy("doc_id", "th", "n").agg(
        F.count_if(F.col("c").isNull()).alias("rows"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("c").alias("classes")
    )
    zero = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("e"))
    add = lambda a, x: F.struct(
        (a["t"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["b"], a["e"]))).cast("long").alias("t"), F.greatest(a["e"], x["e"]).alias("e")
    )
    g = g.select("doc_id", "th", "n", "rows", F.aggregate("spans", zero, add, lambda a: a["t"]).alias("n_hit"), F.explode_outer("classes").alias("c"))
    g = g.join(members, "c", "left").groupBy("doc_id", "th", "n", "rows", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    g = g.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    n = F.col("n").cast("long")
    return g.select("doc_id", n.alias("n_words"), "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= n)).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
