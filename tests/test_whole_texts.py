"""Queries over whole texts, not prefixes."""

from itertools import pairwise

from glyphmill.plans import registry


def test_mojibake_repair(spark, tmp_path):
    text = "naïve — é " * 40
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["mojibake_repair"](spark, str(tmp_path)).first().text == text


def test_viterbi_segment(spark, tmp_path):
    text = "some words " * 40
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spans = registry.queries()["viterbi_segment"](spark, str(tmp_path)).first().spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in pairwise(spans))


def test_morpheme_encode(spark, tmp_path):
    """A word that occurs only beyond 100,000 characters is one piece with its blank."""
    spark.createDataFrame([(1, "a" * 100_000 + " qqqqwwww" * 3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["morpheme_encode"](spark, str(tmp_path)).first().n_tokens == 100_000 + 3
