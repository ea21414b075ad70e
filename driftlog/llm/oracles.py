"""What SQL can express of this subpackage's queries: brute force over whole tables, for DuckDB."""

from __future__ import annotations

#: All pairs of documents that share a shingle, exact similarities, and a walk over the links.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
  UNION ALL SELECT y, x FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) JOIN sizes USING (doc_id)
"""

#: Every window that holds any shingle of an item, wherever it stands, against that item.
DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT r, n, k, p, array_to_string(w[p:p+k-1], ' ') AS g FROM (SELECT r, w, k, len(w) AS n, unnest(range(1, len(w) - k + 2)) AS p FROM d, widths)),
it AS (SELECT item_id, n, k, array_to_string(w[p:p+k-1], ' ') AS g FROM (SELECT item_id, w, k, len(w) AS n, unnest(range(1, len(w) - k + 2)) AS p FROM i JOIN widths ON k = least(len(w), 5))),
ig AS (SELECT item_id, n AS l, k, g, count(*) AS c FROM it GROUP BY ALL),
hit AS (SELECT ds.r, ds.n, ds.p, ig.item_id, ig.l, ig.k, ds.g, ig.c FROM ds JOIN ig ON ds.g = ig.g AND ds.k = ig.k),
win AS (SELECT DISTINCT r, n, item_id, l, k, unnest(range(greatest(1, p - l + k), least(p, greatest(1, n - l + 1)) + 1)) AS st FROM hit),
m AS (SELECT win.r, win.n, win.item_id, win.l, win.k, win.st, hit.g, least(count(*), any_value(hit.c)) AS c
  FROM win JOIN hit ON hit.r = win.r AND hit.item_id = win.item_id AND hit.p BETWEEN win.st AND win.st + win.l - win.k GROUP BY ALL),
s AS (SELECT r, item_id, st, sum(c) AS shared, any_value(least(n, l) - k + 1 + l - k + 1) - sum(c) AS whole FROM m GROUP BY r, item_id, st),
t AS (SELECT d.doc_id, item_id, st, CAST(shared AS DOUBLE) / CAST(whole AS DOUBLE) AS sim FROM s JOIN d USING (r) WHERE 100 * shared >= 75 * whole)
SELECT doc_id, item_id, max(sim) AS similarity, CAST(arg_min(st, struct_pack(a := -sim, b := st)) - 1 AS BIGINT) AS start_word
FROM t GROUP BY doc_id, item_id
"""

SQL = {"op8_near_dedup": NEAR_DEDUP, "op1_decontamination": DECONTAMINATION}
