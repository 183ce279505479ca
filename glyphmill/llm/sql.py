"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d CROSS JOIN lens, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
hits AS (SELECT rid, item, i, bw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT rid, t, count(*) AS c FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
part AS (
  SELECT tf.rid, tf.t, tf.c * 2.2::DOUBLE / (tf.c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.w) / n.mean)) AS part,
         ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) AS idf
  FROM tf JOIN d USING (rid) JOIN df USING (t), n),
scores AS (
  SELECT q.rid AS query, p.rid, round(sum(q.c * p.idf * p.part), 9) AS score
  FROM tf q JOIN d ON d.rid = q.rid AND d.doc_id % 20 = 0 JOIN part p ON p.t = q.t GROUP BY q.rid, p.rid),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rid) AS rank FROM scores)
SELECT q.doc_id, CAST(b.rank AS INTEGER) AS rank, h.doc_id AS hit_doc_id, round(b.score, 6) AS score
FROM best b JOIN d q ON q.rid = b.query JOIN d h ON h.rid = b.rid WHERE b.rank <= 10
"""

_LINES = r"""
docs AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
split_ AS (SELECT rid, doc_id, text, coalesce(CAST(source AS VARCHAR), '') AS site, string_split(text, chr(10)) AS parts FROM docs),
lines AS (
  SELECT rid, doc_id, text, site, i - 1 AS pos, parts[i] AS raw,
         trim(regexp_replace(parts[i], '^[\t\r\f]+|[\t\r\f]+$', '', 'g')) AS line
  FROM split_, unnest(range(1, len(parts) + 1)) t(i)),
bad AS (
  SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first
  FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
marked AS (
  SELECT l.*, coalesce(struct_pack(doc_id := l.doc_id, pos := l.pos) IS DISTINCT FROM b.first AND b.line IS NOT NULL, false) AS gone
  FROM lines l LEFT JOIN bad b ON l.line = b.line),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY rid)
"""

OP10 = f"""
WITH {_LINES.format(docs="documents")}
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk_search": OP5, "op6_winnowing_decontamination": OP6, "op10_line_dedup": OP10}
