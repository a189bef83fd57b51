"""SQL that gives the same rows as the queries that SQL can express."""

P4_LINES = r"""
lines AS (
  SELECT t.base_domain AS site, t.text_id AS id, CAST(u.n AS INTEGER) AS line_no,
         lower(regexp_replace(list_extract(string_split(t.extracted_text, chr(10)), u.n), '[^\p{L}]+', '', 'g')) AS k
  FROM text_out t, LATERAL (SELECT unnest(generate_series(1, len(string_split(t.extracted_text, chr(10))))) AS n) u
  WHERE t.extracted_text IS NOT NULL AND t.base_domain IS NOT NULL AND t.text_id IS NOT NULL),
sites AS (SELECT base_domain AS site, count(DISTINCT text_id) AS n FROM text_out GROUP BY 1),
over AS (
  SELECT l.site, l.k FROM lines l JOIN sites s ON l.site = s.site WHERE l.k <> ''
  GROUP BY l.site, l.k, s.n HAVING count(DISTINCT l.id) >= 4 AND count(DISTINCT l.id) >= 0.15 * s.n - 1e-9)
"""

SQL = {
    "p4_found": f"WITH {P4_LINES} SELECT DISTINCT l.id AS text_id, l.line_no FROM lines l JOIN over o ON l.site = o.site AND l.k = o.k",
    "p4_clean": f"""WITH {P4_LINES},
gone AS (SELECT l.id, list(DISTINCT l.line_no) AS g FROM lines l JOIN over o ON l.site = o.site AND l.k = o.k GROUP BY 1)
SELECT t.text_id, CASE WHEN g.g IS NULL THEN t.extracted_text ELSE
  coalesce((SELECT string_agg(list_extract(string_split(t.extracted_text, chr(10)), u.n), chr(10) ORDER BY u.n)
   FROM (SELECT unnest(generate_series(1, len(string_split(t.extracted_text, chr(10))))) AS n) u WHERE NOT list_contains(g.g, u.n)), '') END AS extracted_text
FROM text_out t LEFT JOIN gone g ON g.id = t.text_id""",
}
