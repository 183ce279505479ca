"""Functions and plain operators against known vectors and definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import arrays, maths
from glyphmill.functions import text as t
from glyphmill.operators import codec, packing, subword, texts
from glyphmill.sources import readers, sinks


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("a", "b", "want"), [("hello world", "hello there", 54.55), ("", "", 100.0), ("hello", "", 0.0)])
def test_similarity(spark, a, b, want):
    assert round(one(spark, t.similarity_percent(F.col("a"), F.col("b")), a=a, b=b), 2) == want


def test_cutoff(spark):
    assert one(spark, t.cutoff(F.col("x")), x=49.99) == 0
    assert one(spark, t.cutoff(F.col("x")), x=50.0) == 50


def test_slots(spark):
    assert one(spark, t.slot_segments(F.col("x")), x="Hi, world.Next  day ") == ["Hi,", " world.", "Next", "  day", " "]


@pytest.mark.parametrize(("x", "want"), [("the  cat", "cat"), ("a tree", "tree"), ("", ""), ("...", ""), ("the of", "the"), ("<unk> the", "the")])
def test_first_content_word(spark, x, want):
    got = one(spark, t.first_content_word(F.col("x")), x=x)
    assert got == want or (x == "<unk> the" and got in ("the", "unk"))


def test_smart_split(spark):
    ids = [0] * 50 + [1] + [0] * 50
    assert one(spark, arrays.smart_split(F.array(*map(F.lit, ids)), 100, [1])) == 51
    assert one(spark, arrays.smart_split(F.array(*[F.lit(0)] * 150), 100, [1])) == 100
    assert packing.split_point(ids, 100, frozenset([1])) == 51


def test_safe_exp(spark):
    assert one(spark, maths.safe_exp(F.col("x")), x=0.0) == 1
    assert one(spark, maths.safe_exp(F.col("x")), x=701.0) == float("inf")
    assert one(spark, maths.safe_exp(F.col("x")), x=float("nan")) == float("inf")


def test_merged_pieces(spark):
    assert one(spark, t.merged_pieces(F.col("x")), x="A b  c ") == ["a", " b", "  ", "c", " "]
    assert one(spark, t.merged_pieces(F.col("x")), x="x \n-1") == ["x", " \n", "-", "1"]


def test_common_prefix(spark):
    for a, b, want in [("abc", "abd", 2), ("", "a", 0), ("ab", "ab", 2), ("xbc", "abc", 0), ("ab", "abc", 2)]:
        assert one(spark, t.common_prefix(F.col("a"), F.col("b")), a=a, b=b) == want


def test_nfc_and_unmangle(spark):
    assert one(spark, t.nfc(F.col("x")), x="é") == "é"
    assert one(spark, t.unmangle(F.col("x")), x="привет".encode().decode("latin-1")) == "привет"
    assert one(spark, t.unmangle(F.col("x")), x="plain") == "plain"


def test_word_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    assert [texts.distance(*x) for x in ([[], ["a"]], [["x"], ["y"]], [["hello", "world"], ["hello", "there"]])] == [1, 1, 1]
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        assert texts.distance(a, b) == slow(a, b)


def test_tail_loop():
    def slow(u, least, most):
        best = None
        for p in range(1, min(most, len(u) // 3) + 1):
            for k in range(3, len(u) // p + 1):
                s = len(u) - p * k
                if s >= least and u[s:] == u[s : s + p] * k and (best is None or s < best):
                    best = s
        return best

    assert texts.loop_of("p1 p2 p3 p4 p5 p6 p7 p8 x y x y x y") == (True, 14, 8)
    r = random.Random(2)
    for _ in range(400):
        u = [r.randrange(2) for _ in range(r.randrange(1, 12))] + [0, 1] * r.randrange(4)
        assert texts.tail_loop(np.array(u), 4, 5) == slow(u, 4, 5)


def test_next_fit():
    got = list(packing.next_fit(iter([[1, 2, 3], [4, 5, 6], [7]]), 5, 0, frozenset()))
    assert got == [[1, 2, 3, 0, 0], [4, 5, 6, 7, 0]]
    long = list(packing.next_fit(iter([list(range(1, 13))]), 5, 0, frozenset([3])))
    assert [x for s in long for x in s if x] == list(range(1, 13)) and all(len(s) == 5 for s in long)


def test_next_fit_text():
    lines = ["ab", "cde", "f" * 30, "g"]
    got = list(packing.next_fit_text(iter(lines), 12))
    assert "".join(got).replace("\\n", "\n") == "".join(x + "\n" for x in lines)
    assert all(len(s.replace("\\n", "\n")) <= 10 for s in got)


def test_pack_lazy_keeps_all(spark):
    rows = [("a", i, 0, f"line {i}") for i in range(50)] + [("b", 1, 0, "x" * 40)]
    df = spark.createDataFrame(rows, "source string, doc_id long, pos int, line string")
    out = packing.pack_lazy(df, "source", ["doc_id", "pos"], 32).orderBy("source", "sample_id").collect()
    for s in "ab":
        assert "".join(r.text for r in out if r.source == s).replace("\\n", "\n") == "".join(x[3] + "\n" for x in rows if x[0] == s)


def test_merges():
    base, merges = subword.learn_merges({" low": 5, " lower": 2, " newest": 6, " widest": 3}, 20)
    assert ("e", "s") in merges and ("es", "t") in merges and len(base) + len(merges) <= 20
    rank = {m: i for i, m in enumerate(merges)}
    assert "".join(codec.merged(list(" lowest"), rank)) == " lowest"


def test_best_pieces_is_best():
    score = {p: -len(p) - (0.5 if p in ("ab", "bc") else 0) + (3 if p == "abc" else 0) for p in ("a", "b", "c", "ab", "bc", "abc")}
    trie = subword.Trie(score)

    def slow(s):
        return max(([p] + slow(s[len(p) :]) for p in trie.prefixes(s, 0)), key=lambda x: sum(score[p] for p in x)) if s else []

    for s in ("abc", "abcab", "aabbcc", "cabcab"):
        assert sum(score[p] for p in subword.best_pieces(s, trie, score, -20)) == sum(score[p] for p in slow(s))


def test_viterbi_spans():
    trie = subword.Trie({"ab": 1, "c": 2, "abc": 3})
    assert subword.viterbi_spans("abc", [0.9, 0.01, 0.01], trie) == [(0, 3)]
    assert subword.viterbi_spans("abc", [0.9, 0.01, 0.99], trie) == [(0, 2), (2, 3)]
    assert subword.viterbi_spans("", [], trie) == []


def test_percentiles(spark):
    from glyphmill.operators.corpus import order_statistics

    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    r = order_statistics(df, "k", "v", {"n": ("nearest", 0.95), "o": ("of_n", 0.95), "l": ("of_last", 0.95), "m": ("of_n", 0.5)}).first()
    assert (r.n, r.o, r.l, r.m) == (4, 4, 3, 3)


def test_files(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "x.txt").write_text("b\na\n", encoding="utf-8")
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "x.txt")).orderBy("line_id").collect()] == ["b", "a"]
    table = pa.table({"id": [1, 2], "text": ["x", "y"]})
    with pa.ipc.new_file(str(tmp_path / "y.arrow"), table.schema) as w:
        w.write_table(table)
    assert sorted(r.text for r in readers.arrow_file(spark, str(tmp_path / "y.arrow")).collect()) == ["x", "y"]
    df = spark.range(250).coalesce(1)
    sinks.write_shards(df, str(tmp_path / "shards"), rows_per_file=50)
    assert sinks.manifest(spark, str(tmp_path / "shards")).agg(F.sum("samples"), F.max("samples")).first()[:] == (250, 50)
    sinks.write_once(spark.range(1), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 250
    sinks.append_log(spark.range(2), str(tmp_path / "log"))
    sinks.append_log(spark.range(3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5
    assert "---" in sinks.latex_table(spark.createDataFrame([("a_b", None)], "name string, v double"))
