"""Similarity is that of whole texts."""

from glyphmill.plans import registry


def test_beyond_the_prefix(spark, tmp_path):
    rows = [(1, 0, "user", "a" * 300), (1, 1, "assistant", "a" * 200 + "b" * 100), (2, 0, "user", "c" * 60 + "d" * 340), (2, 1, "assistant", "c" * 60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.similarity for r in registry.queries()["lev_similarity"](spark, str(tmp_path)).collect()}
    assert got == {1: 66.666667, 2: 15.0}
    got = {r.conv_id: r.score for r in registry.queries()["lev_threshold"](spark, str(tmp_path)).collect()}
    assert got == {1: 66.666667, 2: 0.0}
