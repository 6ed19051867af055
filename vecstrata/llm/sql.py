"""DuckDB SQL of the operators that SQL can state, over whole tables."""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def reached(ids: str) -> str:
    """Smallest id reachable from each id over ``link(a, b)``, both ways."""
    return f"""reach AS (SELECT id AS src, id AS dst FROM ({ids}) UNION SELECT r.src, l.b FROM reach r JOIN link l ON l.a = r.dst),
label AS (SELECT src AS id, min(dst) AS component_id FROM reach GROUP BY src)"""


NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
{reached("SELECT vec_id AS id FROM embeddings")}
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN label ON id = vec_id"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {SPACED}) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, j, j + 4) END, ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS j FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * pair.n >= 80 * (x.n + y.n - pair.n)),
{reached("SELECT doc_id AS id FROM documents")}
SELECT documents.doc_id, coalesce(size.n, 0) AS n_shingles, component_id FROM documents JOIN label ON id = documents.doc_id LEFT JOIN size ON size.doc_id = documents.doc_id"""

DECONTAMINATE = f"""WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, j, j + size - 1), ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {ALNUM}) AS w FROM documents),
place AS (SELECT doc_id, size, j, array_to_string(list_slice(w, j, j + size - 1), ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, place.size AS size, j FROM place JOIN win ON place.s = win.s AND place.size = win.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM doc LEFT JOIN covered ON covered.doc_id = doc.doc_id LEFT JOIN named ON named.doc_id = doc.doc_id"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
win AS (SELECT doc_id, j, sha256(array_to_string(list_slice(w, j, j + 49), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM w WHERE len(w) >= 50)),
early AS (SELECT s, min(doc_id) AS doc_id FROM win GROUP BY 1),
gone AS (SELECT DISTINCT win.doc_id AS doc_id, unnest(range(j, j + 50)) AS p FROM win JOIN early ON win.s = early.s AND early.doc_id < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""
