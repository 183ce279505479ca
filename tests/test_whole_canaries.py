"""A document that repeats a long item matches it whole."""

from glyphmill.operators import evaluation


def test_long_item(spark):
    text = " ".join(f"w{i}" for i in range(120))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "en", "before " + text + " after")], "doc_id long, lang string, text string")
    got = evaluation.canaries(items, docs).collect()
    assert [(r.item_id, r.doc_id, r.n, r.lcp) for r in got] == [(1, 7, 114, 114)]
