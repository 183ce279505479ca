"""Corpus statistics: counts, vocabularies, histograms, order statistics, samples.

Rank statistics are taken from value counts, whose size is that of the value domain, or by
ranges of a sorted table; no group is gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.readers import corpus_lines


def _counted(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode_outer(tokens).alias("token")).filter("token is not null and token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return _counted(docs, F.split(F.col(text), ""))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return _counted(docs, t.word_tokens(F.col(text)))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """Most frequent first, ties by token: a top-k per task, merged."""
    return counts.orderBy(F.desc("cnt"), "token").limit(k)


def vocabulary(counts: DataFrame, size: int, specials: tuple[str, ...] = ()) -> DataFrame:
    """token, id: special tokens first, then the most frequent; at most size rows, so a single task ranks them."""
    top = top_tokens(counts, size - len(specials))
    own = Window.orderBy(F.desc("cnt"), "token")
    ranked = top.select("token", (F.row_number().over(own) + len(specials) - 1).alias("id"))
    if not specials:
        return ranked
    fixed = counts.sparkSession.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id int")
    return fixed.unionByName(ranked)


def tokenizer_profile(docs: DataFrame, size: int, specials: int) -> DataFrame:
    """Per language: tokens, chars, compression, OOV rate, vocabulary use, mean token length, for a word vocabulary of that size.

    Tokens are counted per language before they meet the vocabulary, so the join sees types.
    """
    types = docs.select("lang", F.explode_outer(t.word_tokens(F.col("text"))).alias("token")).filter("token is not null")
    types = types.groupBy("lang", "token").agg(F.count("*").alias("n"))
    vocab = top_tokens(types.groupBy("token").agg(F.sum("n").alias("cnt")), size - specials).select("token", F.lit(True).alias("known"))
    n = F.col("n")
    stats = types.join(F.broadcast(vocab), "token", "left").groupBy("lang").agg(  # at most size rows are broadcast
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), n).otherwise(0)).alias("oov"),
        F.count("known").alias("used"), F.sum(n * F.char_length("token")).alias("token_chars"),
    )
    chars = docs.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.lit(b) if isinstance(b, float) else F.col(b)), 6)
    return stats.join(chars, "lang").select(
        "lang", "tokens", "chars", rate("chars", "tokens").alias("compression"), rate("oov", "tokens").alias("oov_rate"),
        rate("used", float(size)).alias("vocab_utilization"), rate("token_chars", "tokens").alias("avg_token_length"),
    )


def length_histogram(counts: DataFrame, weight: str | None) -> DataFrame:
    """n_chars, cnt: of occurrences (weight) or of types."""
    return counts.groupBy(F.char_length("token").alias("n_chars")).agg((F.sum(weight) if weight else F.count("*")).alias("cnt"))


def order_statistics(df: DataFrame, key: str, value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Per key, values at ranks. Kinds: nearest (round half even of p (n - 1)), of_n (floor of p n), of_last (floor of p (n - 1)).

    From counts of distinct values: running counts per key find the value that holds a rank.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_end", F.sum("c").over(upto)).withColumn("_n", F.sum("c").over(Window.partitionBy(key)))
    index = {
        "nearest": lambda p: F.bround(F.lit(p) * (F.col("_n") - 1)),
        "of_n": lambda p: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1),
        "of_last": lambda p: F.floor(F.lit(p) * (F.col("_n") - 1)),
    }
    return run.groupBy(key).agg(*[F.min(F.when(F.col("_end") > index[kind](p), F.col(value))).alias(name) for name, (kind, p) in wanted.items()])


def length_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """docs, mean, low, high, upper median and 95th percentile (floor of n p) of an integer value."""
    simple = df.groupBy(key).agg(
        F.count("*").alias("docs"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return simple.join(order_statistics(df, key, value, {"median": ("of_n", 0.5), "p95": ("of_n", 0.95)}), key)


def clean_lines(docs: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, pos, chunk, piece: lines without NUL and outer white space, cut into pieces."""
    lines = corpus_lines(docs.withColumn("text", F.replace("text", F.lit("\0"), F.lit(""))))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line <> ''")
    return lines.select("doc_id", "pos", F.posexplode_outer(t.slot_chunks(F.col("line"), most)).alias("chunk", "piece"))


def subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones each time: those of smallest hash."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def numbered(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """Rows with their place in the order of a numeric key, from 0, without one task that sees all rows.

    Bounds of the ranges are taken once and are literals from then on, so counting and
    numbering cut at the same places; a window counts within a range, and the counts of the
    ranges (one row each) give where each begins. Rows without a key come first.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, shares, 100 * parts).alias("b")).first().b or [])) if shares else []  # one row
    literal = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def below(a: Column, s: Column) -> Column:
        return F.when((a + s <= len(bounds)) & (F.get(literal, a + s - 1) < F.col(key)), a + s).otherwise(a)

    place = F.aggregate(steps, F.lit(0), below) if bounds else F.lit(0)  # how many bounds lie below the key
    ranged = df.withColumn("_p", place)
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    sizes = df.select(place.alias("_p")).groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_r")).drop("_p", "_r", "_s")  # one row per range


def chunked_sort(df: DataFrame, key: str, length: str, chunk: int) -> DataFrame:
    """key, chunk, place: chunks of rows in order, within each the longest first."""
    r = numbered(df.select(key, length), key).withColumn("chunk", F.floor(F.col("rn") / chunk))
    return r.select(key, "chunk", F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc(length), key)).alias("place"))
