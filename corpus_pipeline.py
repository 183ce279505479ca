"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage reads the Parquet that the one before has written. The first four return the columns
of documents; the last returns pieces with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontam, jaccard_join, line_dedup, packing, quality
from glyphmill.llm.common import Spool, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at quality.THRESHOLD or more; the others go."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).filter(F.col("score") >= quality.THRESHOLD).drop("score")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document that loses all it had goes."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return out.filter(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.80), that of the smallest id; rows without an id stay."""
    groups = jaccard_join.components(docs, shingle=5, percent=80)
    spool = Spool(spark, "near-copies")
    gone = spool.put(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    spool = Spool(spark, "contaminated")
    gone = spool.put(found.filter("contaminated").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the remaining documents."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the hash order of near copies and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spool = Spool(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = spool.put(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            spool.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
