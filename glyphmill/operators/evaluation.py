"""Evaluators: n-gram language model, benchmark scoring, generation quality, canaries, speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import text as t


def bigrams(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, a, b: neighbouring word tokens, by one pass over the arrays."""
    w = docs.select("doc_id", *keep, t.word_tokens(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return w.select("doc_id", *keep, F.explode_outer(pairs).alias("p")).filter("p is not null").select("doc_id", *keep, "p.a", "p.b")


def _model(pairs: DataFrame, k: float) -> DataFrame:
    """a, b, n, logprob: add-k estimates from pair counts (a, b, n)."""
    heads = pairs.groupBy("a").agg(F.sum("n").alias("total"))
    types = pairs.select("b").distinct().agg(F.count("*").alias("v"))  # one row
    j = pairs.join(heads, "a").crossJoin(F.broadcast(types))
    return j.select("a", "b", "n", F.log((F.col("n") + k) / (F.col("total") + k * F.col("v"))).alias("logprob"))


def bigram_model(docs: DataFrame, k: float = 0.1) -> DataFrame:
    """a, b, n, logprob: add-k estimates from all documents."""
    return _model(bigrams(docs).groupBy("a", "b").agg(F.count("*").alias("n")), k)


def perplexity(docs: DataFrame, split: str, k: float = 0.1) -> DataFrame:
    """split, tokens, chars, ppl, char_ppl of the bigram model on its own corpus: pairs are counted once, per split, and the model adds up these counts."""
    counts = bigrams(docs, split).groupBy(split, "a", "b").agg(F.count("*").alias("c"))
    model = _model(counts.groupBy("a", "b").agg(F.sum("c").alias("n")), k)
    scored = counts.join(model.select("a", "b", "logprob"), ["a", "b"])
    loss = scored.groupBy(split).agg(F.sum("c").alias("tokens"), F.sum(-F.col("c") * F.col("logprob")).alias("loss"))
    chars = docs.groupBy(split).agg(F.sum(F.char_length("text")).alias("chars"))
    return loss.join(chars, split).select(
        split, "tokens", "chars", F.round(maths.safe_exp(F.col("loss") / F.col("tokens")), 4).alias("ppl"), F.round(maths.safe_exp(F.col("loss") / F.col("chars")), 6).alias("char_ppl")
    )


def distinct_n(texts: DataFrame, group: str, n: int, text: str = "text") -> DataFrame:
    """group, n, distinct share of n-grams over the corpus."""
    g = texts.select(group, F.explode_outer(t.ngrams(t.blank_words(F.col(text)), n)).alias("g")).filter("g is not null")
    counts = g.groupBy(group, "g").agg(F.count("*").alias("c"))
    return counts.groupBy(group).agg(F.lit(n).alias("n"), F.round(F.count("*") / F.sum("c"), 9).alias("distinct"))


def repeat_share(n: int, text: str = "text"):
    """Share of n-grams of a text that repeat; null for a text without any."""
    return t.let(t.ngrams(t.blank_words(F.col(text)), n), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)))


def benchmark_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, exact, similarity, thresholded, confidence of rows (prompt, target, generated, logprob)."""
    word, target = F.lower(t.first_content_word(F.col("generated"))), F.lower("target")
    score = t.similarity_percent(t.ascii_fold(word), t.ascii_fold(target))
    confidence = F.exp("logprob") * 100
    finite = F.when(F.isnan(confidence) | (F.abs(confidence) == float("inf")), 0.0).otherwise(F.coalesce(confidence, F.lit(0.0)))
    return pairs.select(*keys, (word == target).cast("int").alias("exact"), score.alias("similarity"), t.cutoff(score).alias("thresholded"), finite.alias("confidence"))


def speed(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median, median absolute deviation (and relative to the median), mean, least and most."""
    m = df.groupBy(group).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")
    )
    mad = df.join(m.select(group, "median"), group).groupBy(group).agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    r = lambda c: F.round(c, 6)
    return m.join(mad, group).select(
        group, "n", r(F.col("median")).alias("median"), r(F.col("mad")).alias("mad"), r(F.try_divide("mad", "median")).alias("rel_mad"), r(F.col("mean")).alias("mean"), "low", "high"
    )


def cosine(vectors: DataFrame, base: DataFrame) -> DataFrame:
    """vec_id, cosine to the one base vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    j = vectors.crossJoin(F.broadcast(base.limit(1).select(F.col("embedding").alias("base"))))
    return j.select("vec_id", F.round(F.try_divide(dot("embedding", "base"), F.sqrt(dot("embedding", "embedding") * dot("base", "base"))), 6).alias("cosine"))


def isotropy(vectors: DataFrame) -> DataFrame:
    """Mean cosine over pairs of different vectors, without any pair: the sum of unit vectors holds all their products."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    unit = vectors.select(F.posexplode("embedding").alias("i", "x"), norm.alias("n")).filter("n > 0")
    sums = unit.groupBy("i").agg(F.sum(F.col("x") / F.col("n")).alias("s"))
    n = vectors.filter(norm > 0).agg(F.count("*").alias("n"))
    total = sums.agg(F.sum(F.col("s") * F.col("s")).alias("t")).crossJoin(n)
    return total.select(F.round((F.col("t") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("isotropy"))


def covariance_spectrum(vectors: DataFrame, dims: int) -> tuple[list[float], int]:
    """Eigenvalues of the covariance, largest first: one aggregation of dims^2 sums, the rest on the driver."""
    import numpy as np

    v = vectors.select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = v.select(F.posexplode("v").alias("i", "x"), "v").select("i", F.posexplode("v").alias("j", "y"), "x")
    sums = rows.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("sx"), F.count("*").alias("n")).collect()  # dims^2 rows
    n = sums[0].n if sums else 0
    c, s = np.zeros((dims, dims)), np.zeros(dims)
    for r in sums:
        c[r.i, r.j], s[r.i] = r.xy, r.sx
    return (sorted(np.linalg.eigvalsh(c / n - np.outer(s, s) / n / n).tolist(), reverse=True) if n else []), n


def canaries(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, lang, n, lcp: how far documents continue an item's first words as the item does, to its end.

    Items are joined on the hash of their first words, which documents show at every place; so
    no document meets every item. Words after a place are taken only where an item begins there.
    """
    w = t.blank_words(F.col("text"))
    head = 6
    i = items.select("item_id", w.alias("w")).filter(F.size("w") >= 2 * head)
    i = i.select("item_id", F.slice("w", 1, head).alias("head"), F.slice("w", F.lit(head + 1), F.greatest(F.size("w"), F.lit(1))).alias("suffix"))
    i = i.withColumn("h", F.xxhash64(F.array_join("head", " ")))
    d = docs.select("doc_id", "lang", w.alias("w"))
    starts = d.select("doc_id", F.posexplode_outer(F.transform(t.ngrams(F.col("w"), head), lambda g: F.xxhash64(g))).alias("p", "h"))
    found = starts.filter(F.col("h").isNotNull()).join(i, "h").select("doc_id", "p", "item_id", "head", "suffix")
    j = found.join(d, "doc_id").filter(F.slice("w", F.col("p") + 1, head) == F.col("head"))
    after = F.slice("w", F.col("p") + (head + 1), F.greatest(F.size("suffix"), F.lit(1)))
    same = F.zip_with("suffix", after, lambda a, b: F.coalesce(a == b, F.lit(False)))
    lcp = t.let(F.array_position(same, False), lambda x: F.when(x == 0, F.size("suffix").cast("long")).otherwise(x - 1))
    return j.select("item_id", "doc_id", "lang", F.size("suffix").alias("n"), lcp.cast("int").alias("lcp"))


def first_rank(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
