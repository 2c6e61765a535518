"""SQL for DuckDB that queries of this subpackage must equal."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
entries AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sets a ON u = a.doc_id JOIN sets b ON v = b.doc_id WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT doc_id, v FROM reach JOIN links ON other = u)
SELECT s.doc_id, len(s.s) AS n_shingles, min(other) AS component_id FROM sets s JOIN reach USING (doc_id) GROUP BY 1, 2
"""

HAMMING = """
WITH codes AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS c FROM embeddings),
pairs AS (
  SELECT q.id AS query_id, b.id AS neighbor_id,
    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.c[i] <> b.c[i] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM codes q JOIN codes b ON q.id % 50 = 0 AND q.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10
"""

LINES = """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM raw),
forms AS (SELECT *, trim(lower(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS form FROM numbered),
firsts AS (SELECT form, min((doc_id, line_no)) AS first FROM forms WHERE form <> '' GROUP BY form),
words AS (SELECT form, first, string_split(form, ' ') AS w FROM firsts WHERE len(string_split(form, ' ')) >= 8),
places AS (SELECT form, first, w, unnest(range(1, len(w) + 1)) AS i FROM words),
rests AS (SELECT form, first, len(w) AS n, i, array_to_string(w[1:i - 1], ' ') || ' ' || array_to_string(w[i + 1:], ' ') AS rest FROM places),
replaced AS (SELECT form FROM (SELECT form, first, min(first) OVER (PARTITION BY n, i, rest) AS low FROM rests) WHERE low < first),
shorter AS (SELECT a.form AS long_form, a.first AS long_first, b.form AS short_form, b.first AS short_first FROM rests a JOIN words b ON trim(a.rest) = b.form),
near AS (SELECT form FROM replaced UNION SELECT long_form FROM shorter WHERE short_first < long_first UNION SELECT short_form FROM shorter WHERE long_first < short_first),
kept AS (
  SELECT f.doc_id, f.line, f.line_no FROM forms f LEFT JOIN firsts USING (form)
  WHERE f.form = '' OR (firsts.first = (f.doc_id, f.line_no) AND f.form NOT IN (SELECT form FROM near))),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(texts.text, '') AS text, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped FROM raw LEFT JOIN texts USING (doc_id)
"""

HARD_NEGATIVES = """
WITH pts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM pts a JOIN pts b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
