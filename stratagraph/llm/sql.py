"""SQL counterparts of the training-data queries where SQL can express them over whole tables."""

from stratagraph.llm.labelled import SPELLINGS

_OWNERS = ", ".join(f"({i}, '{owner}')" for i, (owner, _, _) in enumerate(SPELLINGS))

SQL = {
    "p4_labelled": f"""
WITH l(author_id, owner) AS (VALUES {_OWNERS})
SELECT CAST(a.author_id AS BIGINT) AS author_a, CAST(b.author_id AS BIGINT) AS author_b FROM l a JOIN l b ON a.owner = b.owner AND a.author_id < b.author_id""",
    "p2_found": """
WITH last AS (SELECT id, arg_max(struct_pack(m := message), scanned_at).m AS message FROM commits WHERE id IS NOT NULL GROUP BY id)
SELECT id AS commit_id, CAST(CASE WHEN list_max(list_transform(string_split_regex(message, '[ \\t\\r\\n]'), lambda x: length(x))) > 1000 THEN 1 ELSE 0 END AS BIGINT) AS forced
FROM last WHERE length(message) > 1000""",
    # brute force over all pairs; it equals the search as long as one leaf holds all vectors, as at the correctness scale
    "p3_found": """
WITH v AS (SELECT DISTINCT node_id, chunk_id, embedding::DOUBLE[] AS x FROM node_vectors WHERE len(embedding) = 384 AND list_sum(list_transform(embedding, lambda e: CASE WHEN e IS NULL OR NOT isfinite(e) THEN 1 ELSE 0 END)) = 0 AND list_aggregate(list_transform(embedding, lambda e: abs(e)), 'max') > 0),
s AS (SELECT a.node_id AS na, a.chunk_id AS ca, b.node_id AS nb, b.chunk_id AS cb, list_cosine_similarity(a.x, b.x) AS sim FROM v a JOIN v b ON a.node_id <> b.node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY na, ca ORDER BY sim DESC, nb, cb) AS i FROM s WHERE sim >= 0.6)
SELECT DISTINCT least(na, nb) AS node_a, CAST(CASE WHEN na < nb THEN ca ELSE cb END AS BIGINT) AS chunk_a, greatest(na, nb) AS node_b, CAST(CASE WHEN na < nb THEN cb ELSE ca END AS BIGINT) AS chunk_b FROM r WHERE i <= 10""",
    "p2_rebuilt": """
WITH last AS (SELECT id, arg_max(struct_pack(m := message), scanned_at).m AS message FROM commits WHERE id IS NOT NULL GROUP BY id)
SELECT id AS commit_id, sha256(message) AS digest, true AS within FROM last WHERE length(message) > 1000""",
    "p3_recall": """
WITH v AS (SELECT DISTINCT node_id, chunk_id, embedding::DOUBLE[] AS x FROM node_vectors WHERE len(embedding) = 384 AND list_sum(list_transform(embedding, lambda e: CASE WHEN e IS NULL OR NOT isfinite(e) THEN 1 ELSE 0 END)) = 0 AND list_aggregate(list_transform(embedding, lambda e: abs(e)), 'max') > 0),
q AS (SELECT * FROM v ORDER BY sha256(node_id || ':' || chunk_id) LIMIT 512),
n AS (SELECT q.node_id, q.chunk_id, count(*) AS n FROM q JOIN v ON q.node_id <> v.node_id WHERE list_cosine_similarity(q.x, v.x) >= 0.6 GROUP BY ALL)
SELECT (SELECT count(*) FROM q) AS queries, CAST(coalesce(sum(least(n, 10)), 0) AS BIGINT) AS pairs, true AS reached FROM n""",
    "p9_shares": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 5], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 5)) AS i FROM w)),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(generate_series(i, i + 5)) AS p FROM a WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS words, round(coalesce(covered, 0) / greatest(len(ws), 1), 6) AS share FROM w LEFT JOIN c USING (doc_id)""",
    "p9_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 5], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 5)) AS i FROM w)),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(generate_series(i, i + 5)) AS p FROM a WHERE n > 1) GROUP BY doc_id)
SELECT c.doc_id FROM c JOIN w USING (doc_id) WHERE covered >= 0.3 * len(ws)""",
}
