"""pack_tokens packs every word; documents longer than a sample are cut into several."""

from glyphmill.plans import registry


def test_long_documents(spark, tmp_path):
    rows = [(i, "w " * n, "a") for i, n in enumerate([600, 100, 300])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["pack_tokens"](spark, str(tmp_path)).collect()
    assert [r.used for r in sorted(got, key=lambda r: r.sample_id)] == [256, 256, 188, 256, 44]
