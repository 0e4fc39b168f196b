"""The same results in SQL, for the operators that it can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, words, least(13, len(words)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0),
marks AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS mark
  FROM b, unnest(range(1, len(words) - n + 2)) AS r(i)),
grams AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM marks), unnest(range(1, greatest(len(words) - n + 2, 1))) AS r(i)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN marks ON gram = mark AND grams.n = marks.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                             '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
  FROM split, unnest(range(1, greatest(len(words) - 2, 2))) AS r(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS origin, doc_id AS node FROM documents
  UNION SELECT origin, b FROM reach JOIN links ON a = node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT origin AS doc_id, min(node) AS component_id FROM reach GROUP BY origin) LEFT JOIN sizes USING (doc_id)"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

FILL_IN_MIDDLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
  SELECT doc_id, text, w, len(w) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
         CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(w[1 : a], ''), '') AS prefix,
         coalesce(array_to_string(w[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(w[b + 1 :], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (
  SELECT r, k, substr(x, 800 * k + 1, 1600) AS y, least(400, len(x) // 2 - 399 - 400 * k) AS m
  FROM d, unnest(range(0, (len(x) // 2) // 400 + 1)) AS t(k)),
hashed AS (SELECT r, k, list_transform(range(0, m), lambda i: hash(substr(y, 2 * i + 1, 800))) AS hs FROM blocks WHERE m > 0),
starts AS (SELECT r, 400 * k + unnest(range(0, len(hs))) AS p, unnest(hs) AS h FROM hashed),
many AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p FROM starts JOIN many USING (h)),
marked AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
numbered AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS s FROM marked),
spans AS (SELECT r, s, min(p) AS a, max(p) + 400 AS e FROM numbered GROUP BY r, s),
parts AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM spans),
kept AS (
  SELECT r, CAST(sum(e - a) AS BIGINT) AS gone, count(*) AS n, max(e) AS last,
         string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS front
  FROM parts JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(front || substr(x, 2 * last + 1), x))) AS kept_sha256, coalesce(gone, 0) > 0 AS repeated
FROM d LEFT JOIN kept USING (r)
"""
