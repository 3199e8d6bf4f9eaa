"""DuckDB SQL for those pN_ queries that SQL can express on whole tables."""

P1_FOUND = r"""
WITH v AS (
  SELECT id, 'canonical_name' AS field_name, trim(canonical_name, E' \t\r\n') AS value, source, updated_at FROM kg_entities
  UNION ALL SELECT id, 'status', trim(status, E' \t\r\n'), source, updated_at FROM kg_entities
  UNION ALL SELECT id, 'base_types', array_to_string(list_sort(list_distinct(list_transform(list_filter(base_types, lambda x:
    regexp_matches(x, '[\p{L}\p{N}]') AND lower(trim(x)) NOT IN ('n/a','na','n.a.','tbd','tba','unknown','none','null','nil','undefined','not known','not available','missing','unspecified','unnamed','no name')), lambda x: trim(x)))), '|'), source, updated_at FROM kg_entities),
c AS (SELECT v.*, coalesce(s.trust, 0) AS trust FROM v LEFT JOIN sources s USING (source)
  WHERE value IS NOT NULL AND regexp_matches(value, '[\p{L}\p{N}]') AND NOT regexp_matches(value, '(…|\.\.\.)$')
    AND lower(value) NOT IN ('n/a','na','n.a.','tbd','tba','unknown','none','null','nil','undefined','not known','not available','missing','unspecified','unnamed','no name')
    AND id IN (SELECT id FROM kg_entities GROUP BY id HAVING count(*) > 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, field_name ORDER BY trust DESC, updated_at DESC NULLS LAST, value) AS k FROM c)
SELECT id, field_name, value AS kept_value FROM r WHERE k = 1
"""

P2_FOUND = r"""
WITH items AS (
  SELECT 'document' AS item_kind, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents WHERE length(text) > 1500
  UNION ALL SELECT 'chunk', chunk_id, text FROM chunks WHERE length(text) > 1500),
s AS (SELECT item_kind, item_id,
  list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?؟])[ \t\r\n]+', E'\\1\n', 'g'), '[\r\n]+'), lambda x: length(trim(x, E' \t\r\n')))) AS longest,
  list_max(list_transform(string_split_regex(text, '[ \t\r\n]+'), lambda x: length(x))) AS word FROM items)
SELECT item_kind, item_id, CASE WHEN longest <= 1500 THEN 'sentence' WHEN word <= 1500 THEN 'word' ELSE 'none' END AS boundary FROM s
"""

P2_TEXT = """
SELECT 'document' AS item_kind, CAST(doc_id AS VARCHAR) AS item_id, md5(text) AS text_hash FROM documents WHERE length(text) > 1500
UNION ALL SELECT 'chunk', chunk_id, md5(text) FROM chunks WHERE length(text) > 1500
"""

P4_FOUND = r"""
WITH RECURSIVE n AS (
  SELECT lower(trim(a, E' \t\r\n')) AS x, lower(trim(b, E' \t\r\n')) AS y FROM merge_pairs WHERE sim >= 0.95 AND NOT isnan(sim)),
e AS (SELECT x, y FROM n WHERE x <> y UNION SELECT y, x FROM n WHERE x <> y),
r(x, g) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.x, r.g FROM r JOIN e ON e.y = r.x)
SELECT x AS entity_name, min(g) AS group_id FROM r GROUP BY x
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_text": P2_TEXT, "p4_found": P4_FOUND}
