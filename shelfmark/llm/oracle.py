"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

# Patterns as the contract gives them.
_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def _spans(at: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, {at} AS kind_no, '{kind}' AS kind,
           list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS first,
           list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(hits[:i], lambda x: length(x))) AS past
    FROM (SELECT doc_id, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
                       regexp_extract_all(t, '{pattern}', {group}) AS parts
                FROM texts) AS a) AS b
    WHERE length(parts[i]) >= {least}"""


_OP7 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(at, *kind) for at, kind in enumerate(_KINDS))}),
labels_ AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(past AS BIGINT), ',' ORDER BY first, kind_no) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN labels_ USING (doc_id)"""

_OP10 = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
           label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid
    FROM embeddings),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y
    FROM vectors AS a JOIN vectors AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.valid AND b.valid
      AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reached AS (
    SELECT vec_id AS x, vec_id AS y FROM vectors
    UNION
    SELECT r.x, l.y FROM reached AS r JOIN links AS l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM vectors AS v JOIN least AS l ON l.x = v.vec_id LEFT JOIN counted AS c ON c.x = v.vec_id"""

_OP12 = """
WITH rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
positives AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS positive_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS positive_score
    FROM rows_ AS a JOIN rows_ AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, b.vec_id) <= 5),
others AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS negative_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS negative_score
    FROM rows_ AS a JOIN rows_ AS b ON a.label <> b.label AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0),
ranked AS (
    SELECT anchor_id, positive_id, negative_id, positive_score, negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS place
    FROM positives JOIN others USING (anchor_id)
    WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 10"""

ORACLE: dict[str, str] = {"op10_metric_range_join": _OP10, "op12_hilbert_negatives": _OP12, "op7_secret_ledger": _OP7}
