"""DuckDB SQL for the document queries that SQL can express on small tables."""

from __future__ import annotations

from .secret_scan import BASE, RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), u AS (SELECT doc_id, unnest(s) AS g FROM s
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, low AS component_id, s.doc_id = low AS kept
FROM s JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = s.doc_id
"""

REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS p FROM h)
), again AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again
), span AS (
  SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM span
), per AS (
  SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (b - before))::BIGINT), '' ORDER BY b) AS head FROM cut JOIN h USING (doc_id) GROUP BY 1
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head || substr(h, (2 * last + 1)::BIGINT), h))) AS kept_sha256
FROM h LEFT JOIN per USING (doc_id)
"""


def _secrets() -> str:
    parts = []
    for place, rule in enumerate(RULES):
        rx = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, {rx}) AS gaps, regexp_extract_all(text, {rx}, 0) AS hits, regexp_extract_all(text, {rx}, {rule.group}) AS parts FROM t WHERE regexp_matches(text, {rx})"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS ({' UNION ALL '.join(parts)}
), e AS (SELECT doc_id, place, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m
), spans AS (
  SELECT doc_id, place, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS b, length(hits[i]) AS n
  FROM e WHERE length(parts[i]) >= least
), one AS (SELECT doc_id, place, kind, b::BIGINT AS b, kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT AS s FROM spans
), per AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(s, ',' ORDER BY b, place) FILTER (place < {BASE}) AS base, string_agg(s, ',' ORDER BY b, place) AS spans FROM one GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""


SECRETS = _secrets()
