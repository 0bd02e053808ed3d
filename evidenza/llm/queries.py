"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op6
from .collision_counts import op3
from .html_text import op10
from .language_id import op8
from .license_scan import op7
from .ngram_join import op1
from .packing import op4
from .permutation_index import op2
from .pii import op9
from .token_counts import op5

QUERIES = {
    "op1_ngram_join": op1,
    "op2_permutation_index": op2,
    "op3_collision_counts": op3,
    "op4_best_fit_packing": op4,
    "op5_token_counts": op5,
    "op6_byte_bpe": op6,
    "op7_license_scan": op7,
    "op8_language_id": op8,
    "op9_pii": op9,
    "op10_html_text": op10,
}

#: The exact joins; the others cannot be expressed in SQL on whole tables, and tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": """WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.least FROM reach r JOIN linked l ON l.a = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node AS doc_id, min(least) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op3_collision_counts": """WITH RECURSIVE links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.98),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.least FROM reach r JOIN linked l ON l.a = r.node),
parts AS (SELECT node AS vec_id, min(least) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM linked WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts""",
}
