"""The pipeline's stages and the queries of the operators."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.compare import SMALL, connection, same

from glyphmill.llm import decontam, jaccard_join, line_dedup, packing, quality, queries, sql

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SMALL), sql.oracle_sql()[name], connection())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes), name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "ngram_jaccard_join":
            groups = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
            assert kept == set(groups.values())
        if name == "benchmark_decontamination":
            found = decontam.contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert kept == {r.doc_id for r in found.filter("not contaminated").collect()}
        docs = out.persist()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    """The whole pipeline gives the pieces that its stages give one after the other, decided anew outside of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels), keep=["doc_id"]).collect()}
    kept = docs.filter(F.col("doc_id").isin([i for i, x in scores.items() if x >= quality.THRESHOLD]))
    lines = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(kept).collect()]
    kept = spark.createDataFrame([(i, x) for i, x, n in lines if n == 0 or (x or "").strip()], "doc_id long, text string")
    words = {r.doc_id: [w for w in re.split(r"[ \t-\r]+", (r.text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) if w] for r in kept.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a]) * 5 >= len(sets[b]) * 4 and len(sets[b]) * 5 >= len(sets[a]) * 4 and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = kept.filter(F.col("doc_id").isin([i for i in sets if find(i) == i]))
    clean = decontam.contamination(kept, benchmark).filter("not contaminated").select("doc_id")
    want = packing.pack(kept.join(clean, "doc_id")).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(tuple(r) for r in want.collect()) and got.count() > 0


def test_stages_with_clashing_columns_and_long_texts(spark):
    """Extra columns with names that the operators use inside stay as they are; a text of 1 MB passes."""
    rows = [(1, "word " * 200_000, "en", "a", None, 7, "r", 1.5), (2, "some text here", "en", "b", 14, 8, "s", 2.5), (2, "some text here", "en", "b", 14, 8, "s", 2.5)]
    data = spark.createDataFrame(rows, f"{TABLE}, key long, rid string, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, data, SMALL)
        wanted = [c for c in data.columns if not (name == "quality_classifier" and c == "score")]
        assert set(wanted) <= set(out.columns), name
        assert {(r.doc_id, r.key, r.rid) for r in out.collect()} <= {(1, 7, "r"), (2, 8, "s")}
    assert {r.doc_id for r in packing.pack(data).collect()} == {1, 2}


def test_stages_on_hard_rows(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "x y z", "en", "a", 5), (4, "x y z", "en", "b", 5), (4, "x y z", "en", "b", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, TABLE)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            out.collect()
            docs = out if out.columns == docs.columns else docs


def test_packing_round_trip(spark):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(0, 2500, 100)], "doc_id long, text string")
    out = packing.pack(docs).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in out}.keys() == {r.doc_id for r in docs.collect()}


def test_near_copies_from_080(spark):
    """A copy with a sixth of its text appended: 0.83 by five words, below 0.85 by four."""
    words = [f"w{i}" for i in range(240)]
    docs = spark.createDataFrame([(1, " ".join(words[:200])), (2, " ".join(words)), (3, " ".join(words[120:]))], "doc_id long, text string")
    assert len({r.component_id for r in jaccard_join.components(docs).collect()}) == 3
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL).collect()} == {1, 3}
