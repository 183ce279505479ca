"""Operators whose plan depends on partitions, counts or rules that small tables do not show."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus, logs, subword, texts
from tests.compare import connection, same

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("partitions", [16, 64])
def test_chunked_sort_of_more_rows_than_a_sample(spark, partitions):
    from glyphmill.plans import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(registry.queries()["chunked_sort"](spark, LARGE), registry.oracle_sql()["chunked_sort"], connection(LARGE))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_ties_and_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (3,), (2,), (3,)], "k long")
    assert sorted((r.rn, r.k) for r in corpus.numbered(df, "k").collect()) == [(0, None), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3)]
    assert corpus.numbered(df.limit(0), "k").count() == 0


def test_early_stopping_rules(spark):
    values = [9.0, float("nan"), 1.0, 1.1, None, float("inf"), 1.2, 1.3]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run int, step long, v double")
    assert logs.stopped_at(df, "run", "step", "v", 2).first().stop == 6
    assert logs.stopped_at(df, "run", "step", "v", 2, min_steps=3).first().stop == 7
    assert logs.stopped_at(df, "run", "step", "v", 9).first().stop is None


def _plain_merges(types, size):
    words = {w: list(w) for w in types}
    merges = []
    base = len({c for w in types for c in w})
    while base + len(merges) < size:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] += types[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        for w, s in words.items():
            out = []
            for c in s:
                if out and (out[-1], c) == best:
                    out[-1] += c
                else:
                    out.append(c)
            words[w] = out
    return merges


def test_merges_by_heap():
    types = {"abab": 5, "aba": 4, "bcbc": 3, "aaaa": 2, "cab": 2, "abcabc": 1, "x": 9}
    for size in (4, 8, 12, 50):
        assert subword.learn_merges(types, size)[1] == _plain_merges(types, size)


def test_viterbi_against_all_segmentations():
    trie, text, p = subword.Trie({"ab": 1, "abc": 2, "c": 3, "bc": 4, "cab": 5}), "abcabxcab", [0.3, 0.8, 0.1, 0.6, 0.5, 0.9, 0.2, 0.7]
    q = [*p, 0.5]

    def every(at):
        if at == len(text):
            yield []
        for piece in trie.prefixes(text, at) or [text[at : at + 1]] if at < len(text) else []:
            for rest in every(at + len(piece)):
                yield [(at, at + len(piece)), *rest]

    gain = lambda spans: sum((math.log(q[a]) if a else 0) + sum(math.log(1 - q[k]) for k in range(a + 1, e)) + 0.35 * (e - a - 1) for a, e in spans)
    assert subword.viterbi_spans(text, p, trie) == max(every(0), key=gain)
    assert subword.viterbi_spans("", [], trie) == [] and subword.viterbi_spans("zz", [], trie) == [(0, 1), (1, 2)]


def test_untrimmed_texts_keep_their_white_space(spark):
    df = spark.createDataFrame([(1, " a  b\n c "), (2, "a b c d e f g h " + "x y " * 5), (3, None)], "k int, text string")
    got = {r.k: (r.text, r.trimmed) for r in texts.trimmed(df, ["k"], n=2, most=2, least_words=8).collect()}
    assert got[1] == (" a  b\n c ", False) and got[2][1] and got[3] == (None, False)


def test_long_texts_cost_in_proportion(spark):
    """n-grams of a text of 40,000 words (nested loops over it would take minutes)."""
    from glyphmill.functions import text as t

    df = spark.createDataFrame([(" ".join(f"w{i % 977}" for i in range(40_000)),)], "text string")
    assert df.select(F.size(t.ngrams(t.blank_words(F.col("text")), 3)).alias("n")).first().n == 39_998
