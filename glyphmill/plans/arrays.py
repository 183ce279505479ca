"""Queries over token-id arrays. Ids here are code points of the benchmark texts modulo 50, so 0 doubles as padding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import text as t
from .registry import query, table

_IDS = "ids AS (SELECT item_id, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) % 50 AS INTEGER)) AS ids FROM benchmark)"


def _ids(spark, d):
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return table(spark, d, "benchmark").select("item_id", F.transform(chars, lambda c: (F.ascii(c) % 50).cast("int")).alias("ids"))


@query("add_specials", f"WITH {_IDS} SELECT item_id, list_prepend(2, list_append(ids, 3)) AS ids FROM ids")
def add_specials(spark, d):
    return _ids(spark, d).select("item_id", a.add_specials(F.col("ids"), 2, 3).alias("ids"))


@query("truncate_tail", f"WITH {_IDS} SELECT item_id, ids[greatest(1, len(ids) - 63):] AS ids FROM ids")
def truncate_tail(spark, d):
    return _ids(spark, d).select("item_id", a.tail(F.col("ids"), 64).alias("ids"))


@query("pad_and_mask", f"""
WITH {_IDS}, p AS (SELECT item_id, list_concat(ids[1:256], list_transform(range(0, greatest(0, 256 - len(ids))), lambda i: 0)) AS ids FROM ids)
SELECT item_id, ids, list_transform(ids, lambda x: CAST(x <> 0 AS INTEGER)) AS mask FROM p""")
def pad_and_mask(spark, d):
    p = _ids(spark, d).select("item_id", a.pad_right(F.col("ids"), 256, 0).alias("ids"))
    return p.select("item_id", "ids", a.mask_of(F.col("ids"), 0).alias("mask"))


@query("pad_left", f"WITH {_IDS} SELECT item_id, list_concat(list_transform(range(0, greatest(0, 256 - len(ids))), lambda i: 0), ids[greatest(1, len(ids) - 255):]) AS ids FROM ids")
def pad_left(spark, d):
    return _ids(spark, d).select("item_id", a.pad_left(F.col("ids"), 256, 0).alias("ids"))


@query("pad_slots", r"""
WITH w AS (SELECT item_id, list_transform(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(string_split(w, ''), lambda c: CAST(unicode(c) AS INTEGER))) AS s FROM benchmark)
SELECT item_id, list_concat(list_transform(s[1:24], lambda w: list_concat(w[1:8], list_transform(range(0, greatest(0, 8 - len(w))), lambda i: 0))),
  list_transform(range(0, greatest(0, 24 - len(s))), lambda i: [0, 0, 0, 0, 0, 0, 0, 0])) AS slots FROM w""")
def pad_slots(spark, d):
    code = lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.ascii(c))
    s = table(spark, d, "benchmark").select("item_id", F.transform(t.blank_words(F.col("text")), code).alias("s"))
    return s.select("item_id", a.pad_slots(F.col("s"), 24, 8, 0).alias("slots"))


@query("labels_ignore", f"WITH {_IDS} SELECT item_id, list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)[2:] AS labels FROM ids")
def labels_ignore(spark, d):
    return _ids(spark, d).select("item_id", a.labels_of(F.col("ids"), 0).alias("labels"))


@query("flatten_ids", f"WITH {_IDS} SELECT item_id, ids, len(ids) AS n FROM ids")
def flatten_ids(spark, d):
    """Word lists flattened back; chunks of seven stand for words."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / 7).cast("int")), lambda i: F.slice("ids", i * 7 + 1, 7))
    return _ids(spark, d).select("item_id", F.flatten(chunks).alias("ids")).select("item_id", "ids", F.size("ids").cast("long").alias("n"))


@query("smart_split", f"""
WITH {_IDS} SELECT item_id, CAST(CASE WHEN len(ids) <= 120 THEN len(ids)
  ELSE coalesce(list_max(list_filter(range(1, 120), lambda i: ids[i + 1] IN (46, 44, 12))) + 1, 120) END AS INTEGER) AS keep FROM ids""")
def smart_split(spark, d):
    return _ids(spark, d).select("item_id", a.smart_split(F.col("ids"), 120, [46, 44, 12]).alias("keep"))


@query("trim_pads", f"""
WITH {_IDS}, p AS (SELECT item_id, list_concat([0, 0], list_concat(ids[1:20], list_concat([0], ids[21:]))) AS ids FROM ids),
b AS (SELECT item_id, ids, list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0)[1] AS b FROM p),
r AS (SELECT item_id, ids[b:] AS r FROM b)
SELECT item_id, CASE WHEN list_position(r, 0) > 0 THEN r[1:list_position(r, 0) - 1] ELSE r END AS ids FROM r""")
def trim_pads(spark, d):
    zero = F.array(F.lit(0))
    padded = F.concat(zero, zero, F.slice("ids", 1, 20), zero, F.slice("ids", F.lit(21), F.greatest(F.size("ids"), F.lit(1))))
    return _ids(spark, d).select("item_id", padded.alias("ids")).select("item_id", a.trim_pads(F.col("ids"), 0).alias("ids"))


@query("drop_specials", f"WITH {_IDS} SELECT item_id, list_filter(ids, lambda x: x NOT IN (0, 1, 2, 3)) AS ids FROM ids")
def drop_specials(spark, d):
    return _ids(spark, d).select("item_id", F.filter("ids", lambda x: ~x.isin(0, 1, 2, 3)).alias("ids"))


@query("boundary_masks", f"""
WITH {_IDS}, s AS (SELECT item_id, len(ids) AS n, list_filter(range(0, len(ids)), lambda i: i = 0 OR ids[i + 1] % 5 = 0) AS starts FROM ids)
SELECT item_id, list_transform(range(0, n), lambda i: CAST(list_contains(starts, i) AS INTEGER)) AS starts, list_transform(range(0, n), lambda i: CAST(NOT list_contains(starts, i) AS INTEGER)) AS inside FROM s""")
def boundary_masks(spark, d):
    at = t.positions(0, F.size("ids") - 1)
    s = _ids(spark, d).select("item_id", F.size("ids").alias("n"), F.filter(at, lambda i: (i == 0) | (F.get("ids", i) % 5 == 0)).alias("s"))
    starts, inside = a.boundary_masks(F.col("s"), F.col("n"))
    return s.select("item_id", starts.alias("starts"), inside.alias("inside"))


def _flags(spark, d):
    rows = _ids(spark, d).select("item_id", F.posexplode_outer("ids").alias("pos", "x"))
    return rows.withColumn("is_start", (F.col("pos") == 0) | (F.col("x") % 5 == 0))


@query("segment_ranges", f"""
WITH {_IDS}, x AS (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS pos FROM ids),
g AS (SELECT item_id, pos, sum(CASE WHEN pos = 0 OR x % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS seg FROM x)
SELECT item_id, CAST(seg AS BIGINT) AS segment, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM g GROUP BY item_id, seg""")
def segment_ranges(spark, d):
    seg = F.sum(F.col("is_start").cast("long")).over(Window.partitionBy("item_id").orderBy("pos"))
    return _flags(spark, d).withColumn("segment", seg).groupBy("item_id", "segment").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("boundary_select", f"""
WITH {_IDS}, x AS (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM ids),
r AS (SELECT item_id, pos, n, row_number() OVER (PARTITION BY item_id ORDER BY x * 7919 % 101 DESC, pos) AS rn FROM x)
SELECT item_id, CAST(pos AS INTEGER) AS pos FROM r WHERE pos = 0 OR rn <= round_even(0.2::DOUBLE * n, 0)""")
def boundary_select(spark, d):
    """The first place and as many of the likeliest ones as the rate asks for."""
    rows = _ids(spark, d).select("item_id", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("pos", "x"))
    rn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.col("x") * 7919 % 101), "pos"))
    return rows.withColumn("rn", rn).filter((F.col("pos") == 0) | (F.col("rn") <= F.bround(F.lit(0.2) * F.col("n")))).select("item_id", "pos")


@query("boundary_prf", f"""
WITH {_IDS}, x AS (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS pos FROM ids),
c AS (SELECT count(*) FILTER (WHERE x % 5 = 0 AND x % 2 = 0) AS both_, count(*) FILTER (WHERE x % 5 = 0) AS gold, count(*) FILTER (WHERE x % 2 = 0) AS found FROM x WHERE pos > 0)
SELECT round(both_ / found, 9) AS precision, round(both_ / gold, 9) AS recall, round(2.0 * both_ / (gold + found), 9) AS f1 FROM c""")
def boundary_prf(spark, d):
    """Gold and found boundaries, the first place apart."""
    rows = _flags(spark, d).filter("pos > 0")
    gold, found = F.col("x") % 5 == 0, F.col("x") % 2 == 0
    c = rows.agg(F.count_if(gold & found).alias("b"), F.count_if(gold).alias("g"), F.count_if(found).alias("f"))
    rate = lambda x, y: F.round(F.try_divide(x, y), 9)
    return c.select(rate(F.col("b"), F.col("f")).alias("precision"), rate(F.col("b"), F.col("g")).alias("recall"), rate(2.0 * F.col("b"), F.col("g") + F.col("f")).alias("f1"))


@query("prefix_token_len", r"""
WITH w AS (SELECT item_id, text, len(text) // 2 AS cut FROM benchmark)
SELECT item_id, len(regexp_extract_all(left(text, CAST(cut AS INTEGER)), '\S+')) AS n FROM w""")
def prefix_token_len(spark, d):
    """How many words begin before a character place."""
    b = table(spark, d, "benchmark").withColumn("cut", F.floor(F.char_length("text") / 2).cast("int"))
    return b.select("item_id", F.size(F.regexp_extract_all(F.substring("text", F.lit(1), F.col("cut")), F.lit(r"\S+"), F.lit(0))).cast("long").alias("n"))


@query("prefix_sums", f"""
WITH {_IDS}, x AS (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS pos FROM ids)
SELECT item_id, CAST(pos AS INTEGER) AS pos, round(sum(ln(1 - (x + 1) / 60.0::DOUBLE)) OVER (PARTITION BY item_id ORDER BY pos), 6) AS total FROM x""")
def prefix_sums(spark, d):
    rows = _ids(spark, d).select("item_id", F.posexplode_outer("ids").alias("pos", "x"))
    run = F.sum(F.log1p(-(F.col("x") + 1) / 60.0)).over(Window.partitionBy("item_id").orderBy("pos"))
    return rows.select("item_id", "pos", F.round(run, 6).alias("total"))


@query("boundary_threshold", """
WITH p AS (SELECT event_type, (value - floor(value)) AS p FROM events)
SELECT event_type, round(greatest(0.02::DOUBLE, least(0.5::DOUBLE, quantile_cont(p, 0.8))), 6) AS threshold,
       round(greatest(1.0::DOUBLE, least(8.0::DOUBLE, count(*) FILTER (WHERE p <= 0.3) / greatest(1, count(*) FILTER (WHERE p > 0.3))::DOUBLE)), 6) AS weight FROM p GROUP BY event_type""")
def boundary_threshold(spark, d):
    p = table(spark, d, "events").select("event_type", (F.col("value") - F.floor("value")).alias("p"))
    threshold = F.greatest(F.lit(0.02), F.least(F.lit(0.5), F.percentile("p", F.lit(0.8))))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.count_if(F.col("p") <= 0.3) / F.greatest(F.lit(1), F.count_if(F.col("p") > 0.3))))
    return p.groupBy("event_type").agg(F.round(threshold, 6).alias("threshold"), F.round(weight, 6).alias("weight"))


@query("oov_segment_penalty", f"""
WITH {_IDS}, x AS (SELECT item_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS pos FROM ids),
g AS (SELECT item_id, pos, x, sum(CASE WHEN pos = 0 OR x % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS seg FROM x),
s AS (SELECT item_id, seg, min(pos) AS first, list(x ORDER BY pos) AS piece FROM g GROUP BY item_id, seg),
v AS (SELECT piece FROM s GROUP BY piece HAVING count(*) >= 3),
o AS (SELECT * FROM s ANTI JOIN v USING (piece)),
p AS (SELECT CASE WHEN pos > first THEN 1 - x * 7919 % 101 / 101.0::DOUBLE WHEN pos > 0 THEN x * 7919 % 101 / 101.0::DOUBLE ELSE 0 END AS p FROM g JOIN o USING (item_id, seg))
SELECT round(sum(p) / (SELECT count(*) FROM x), 9) AS penalty FROM p""")
def oov_segment_penalty(spark, d):
    """Segments that are no piece of the vocabulary (here: of three occurrences or more) cost the probability of their start and what the places inside lack."""
    seg = F.sum(F.col("is_start").cast("long")).over(Window.partitionBy("item_id").orderBy("pos"))
    rows = _flags(spark, d).filter("x is not null").withColumn("seg", seg).withColumn("p", F.col("x") * 7919 % 101 / 101.0)
    return a.segment_penalty(rows, "item_id", 3).select(F.round("penalty", 9).alias("penalty"))
