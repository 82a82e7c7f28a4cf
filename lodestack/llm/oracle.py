"""SQL (DuckDB) for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Words of a text as a list, as decontam.py and license_scan.py take them.
ALNUM = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op10_decontaminate"] = f"""
WITH b AS (SELECT item_id, {ALNUM.format(t='text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM.format(t='text')} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g
      FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
m AS (SELECT g.r, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

#: Words of a text as a list, as ngram_join.py takes them.
SPACED = "list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SQL["op7_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED.format(t='text')} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT j, i FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT i AS v, i AS u FROM l UNION SELECT l.j, r.u FROM r JOIN l ON r.v = l.i),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN m ON s.doc_id = m.v
"""

SQL["op9_line_dedup"] = """
WITH o AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(string_split(replace(replace(lower(line), chr(9), ' '), chr(13), ' '), ' '), lambda x: x <> '') AS w FROM o),
k AS (SELECT doc_id, pos, line, w, doc_id * 4294967296 + pos AS place FROM w WHERE len(w) > 0),
u AS (SELECT line, min(place) AS first, any_value(w) AS w FROM k GROUP BY line),
s AS (SELECT line, first, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM u),
x AS (SELECT line, first, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.line, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND b.first < a.first GROUP BY a.line, b.line),
g AS (SELECT DISTINCT line FROM p WHERE 180 * c >= 80 * (na + nb)),
z AS (SELECT k.doc_id, k.pos FROM k JOIN u USING (line) WHERE k.place > u.first OR line IN (SELECT line FROM g)),
q AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM z GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN q USING (doc_id)
"""

SQL["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT d.*, first, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d JOIN f USING (t)),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS b
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, b, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, b),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_reduce(list_transform(o, lambda j: chr(CAST(64 + j AS INT))), lambda x, y: x || y) AS filter_order, k.i AS step, o[k.i] AS f, o[1:k.i - 1] AS earlier FROM o, i k),
r AS (SELECT part, filter_order, step, f,
  coalesce(sum(n) FILTER (len(list_filter(earlier, lambda j: b[j])) = 0 AND NOT b[f]), 0) AS kept,
  coalesce(sum(n) FILTER (len(list_filter(earlier, lambda j: b[j])) = 0 AND b[f]), 0) AS removed,
  coalesce(sum(n) FILTER (len(list_filter(earlier, lambda j: b[j])) > 0 AND b[f]), 0) AS redundant,
  coalesce(sum(n) FILTER (b[f] AND len(list_filter(b, lambda y: y)) = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (len(list_filter(earlier, lambda j: b[j])) = 0 AND b[f]), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (len(list_filter(earlier, lambda j: b[j])) = 0 AND b[f]), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
