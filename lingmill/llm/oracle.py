"""DuckDB SQL for the queries that SQL can express on whole tables."""

_W = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ROWS = f"""
rows AS (
  SELECT DISTINCT value, grp, doc, portion, count FROM word_t
  WHERE value IS NOT NULL AND length(regexp_replace(value, '{_W}', '', 'g')) > 0 AND count >= 1
),
terms AS (
  SELECT value, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT (grp, doc)) AS docs FROM rows GROUP BY value
)"""

_SCORES = """
cells AS (
  SELECT language, text, coalesce(sum(CASE WHEN weight > 0 THEN weight END), 0) AS w FROM model_pairs
  WHERE language IS NOT NULL AND text IS NOT NULL GROUP BY language, text
),
term AS (SELECT text, sum(w) AS term_w, count(*) AS n_records FROM cells GROUP BY text),
rec AS (SELECT language, sum(w) AS record_w FROM cells GROUP BY language),
whole AS (SELECT sum(record_w) AS all_w, avg(record_w) AS mean_w FROM rec),
scored AS (
  SELECT language, text, w AS weight, n_records,
         CASE WHEN term_w > 0 AND record_w > 0
              THEN (w + mean_w * 0.1 * (term_w / all_w)) / (record_w + mean_w * 0.1)
                   * ln((w + mean_w * 0.1 * (term_w / all_w)) / (record_w + mean_w * 0.1) / (term_w / all_w))
              ELSE 0 END AS score
  FROM cells JOIN term USING (text) JOIN rec USING (language), whole
)"""

ORACLE = {
    "p1_found": "SELECT doc_id FROM documents WHERE length(text) > 4000",
    "p6_found": f"""WITH {_ROWS}, n AS (SELECT count(DISTINCT (grp, doc)) AS n_docs FROM rows)
SELECT value, 'rare' AS band FROM terms WHERE total <= 2
UNION ALL SELECT value, 'common' AS band FROM terms, n WHERE docs > 0.5 * n_docs""",
    "p6_counts": f"WITH {_ROWS} SELECT value, total, docs FROM terms",
    "p7_found": f"""WITH {_SCORES}
SELECT language, text FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score DESC, text) AS r FROM scored) WHERE r <= 5""",
}
