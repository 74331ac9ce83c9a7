"""DuckDB SQL with the same result as those registered queries that SQL can express."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in ("### ", "</turn>"):
        out = f"replace({out}, '{control}', '\\{control}')"
    return out


_SAID = r"\### Assistant: </turn> ok"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(replace({_escaped('role')}, ':', '\\:')) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: Links by all pairs, components by reachability.
_COMPONENTS = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, c) AS (SELECT a, a FROM ways UNION SELECT ways.b, reach.c FROM reach JOIN ways ON ways.a = reach.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
deg AS (SELECT a AS v, count(*) AS n FROM ways GROUP BY a)
"""

EMBEDDINGS = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT s.vec_id AS a, t.vec_id AS b FROM e s JOIN e t ON s.label = t.label AND s.vec_id < t.vec_id AND len(s.x) = len(t.x)
          WHERE s.n > 0 AND t.n > 0 AND list_sum(list_transform(list_zip(s.x, t.x), lambda z: z[1] * z[2])) / (s.n * t.n) >= 0.98),
{_COMPONENTS}
SELECT vec_id, coalesce(deg.n, 0) AS n_links, coalesce(comp.c, vec_id) AS component_id, coalesce(comp.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON deg.v = vec_id LEFT JOIN comp ON comp.v = vec_id
"""

NGRAMS = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * m >= 4 * (na.n + nb.n - m)),
{_COMPONENTS}
SELECT w.doc_id, coalesce(deg.n, 0) AS n_links, coalesce(comp.c, w.doc_id) AS class_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN deg ON deg.v = w.doc_id LEFT JOIN comp ON comp.v = w.doc_id
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q, true), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
