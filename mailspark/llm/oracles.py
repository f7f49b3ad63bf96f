"""DuckDB SQL for the operators that SQL can express on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_sets(table: str, key: str, n: int) -> str:
    """(key, s): distinct n-word shingles of each row's text, the whole sequence where it is shorter."""
    return f"""SELECT {key}, list_distinct(CASE
      WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table})"""


CONTAMINATION = f"""WITH i AS ({shingle_sets('benchmark', 'item_id', 5)}), d AS ({shingle_sets('documents', 'doc_id', 5)}),
iu AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM i), du AS (SELECT doc_id, unnest(s) AS x FROM d)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM iu JOIN du USING (x) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= 80 * n"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS ({shingle_sets('documents', 'doc_id', 4)}),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
e AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT p AS a, q AS b FROM e UNION SELECT reached.a, e.q FROM reached JOIN e ON e.p = reached.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM d LEFT JOIN least ON a = doc_id"""

LINES = """WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\\x09-\\x0D ]+'), lambda w: w <> ''))) AS s
  FROM l),
c AS (SELECT s, len(s) AS n, min({'d': doc_id, 'l': line_no}) AS first, row_number() OVER () AS id FROM k WHERE len(s) > 0 GROUP BY s),
f AS (SELECT w, count(*) AS df FROM (SELECT unnest(s) AS w FROM c) GROUP BY w),
p AS (
  SELECT id, n, first, s, w FROM (SELECT id, n, first, s, unnest(s) AS w FROM c) JOIN f USING (w)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, w) <= n - ceil(n * 0.8) + 1),
m AS (
  SELECT DISTINCT b.id FROM p a JOIN p b ON a.w = b.w AND a.first < b.first AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  WHERE len(list_intersect(a.s, b.s)) * 180 >= 80 * (a.n + b.n)),
gone AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed_lines
  FROM k JOIN c USING (s) WHERE id IN (SELECT id FROM m) OR {'d': doc_id, 'l': line_no} <> first GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN gone USING (doc_id)"""

HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
m AS (
  SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM m WHERE rank <= 3"""

FILL_IN_MIDDLE = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS plain, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS spm FROM d),
f AS (
  SELECT doc_id, n, t, least(a, b) AS x, greatest(a, b) AS y, CASE
    WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain'
    WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (
  SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END)
    AS output_sha256, sha256(t) AS restored_sha256
FROM o"""
