"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

A HyperLogLog sketch of the sites per line hash merges by aggregation (map side first, so a
hot line moves one sketch per task). Lines whose estimate is clearly below or above the
threshold are settled by it; lines near the threshold get an exact distinct count. A
boilerplate line stays at its first place (smallest id, then position) and goes everywhere
else. Texts move only where a document loses a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spool, only

MIN_SITES, LG_K = 10, 12
#: Three standard errors of a sketch of 2^LG_K registers, and more.
MARGIN = 0.1


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Of lines (key, site, doc_id, pos): key and first place of each line on min_sites sites or more."""
    spool = Spool(lines.sparkSession, "line-spread")
    lo, hi = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    spread = lines.groupBy("key").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")
    )
    spread = spread.filter(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = spool.put(spread.filter(F.col("sites") >= lo), "spread")
    near = spread.filter(F.col("sites") <= hi).select("key", "first")
    exact = lines.join(near.select("key"), "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("sites"))
    near = near.join(exact.filter(F.col("sites") >= min_sites), "key").select("key", "first")
    return spread.filter(F.col("sites") > hi).select("key", "first").unionByName(near)


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """All columns of docs, the text without boilerplate lines, and n_lines and n_removed.

    Lines are split at \\n and compared trimmed; blank lines are never boilerplate. A null text
    stays null with no lines, an empty one is one blank line. A null site counts as the site
    ''. Of rows that repeat with the same id and text all keep a first line. Equal ids with other texts are
    documents of their own. An empty table gives no rows. Other columns pass through, except
    that n_lines and n_removed of docs are replaced.
    """
    spool = Spool(docs.sparkSession, "line-dedup")
    d = only(docs, doc_id=id_col, site=site_col, text=text_col)
    site = F.coalesce(F.col("site").cast("string"), F.lit(""))
    rows = d.select("doc_id", F.xxhash64("text").alias("th"), site.alias("site"), F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"^[\t\r\f]+|[\t\r\f]+$", "")))
    lines = spool.put(rows.filter(F.col("line") != "").select("doc_id", "th", "site", "pos", _key(F.col("line")).alias("key")), "lines")
    found = spool.put(boilerplate(lines, min_sites), "boilerplate")
    drop = lines.join(found, "key").filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    drop = drop.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set("pos")).alias("_drop"))
    base = docs.drop("n_lines", "n_removed")
    j = base.join(drop, docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th")), "left")
    text = docs[text_col]
    parts = F.split(text, "\n", -1)
    # Runs between removed positions, so that a text of very many lines costs one pass.
    edges = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size(parts)))
    return j.select(
        *[F.when(F.col("_drop").isNull(), text).otherwise(_without(parts, edges)).alias(c) if c == text_col else base[c] for c in base.columns],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _without(parts: Column, edges: Column) -> Column:
    run = lambda i: F.slice(parts, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1)
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), run)), "\n")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (null text: of nothing)."""
    out = dedup_lines(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
