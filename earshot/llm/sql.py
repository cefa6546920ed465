"""The same queries in SQL, where SQL can say them."""

from __future__ import annotations

_SCORES = """
scores AS (
  SELECT 'wer' AS metric, language, CAST(scored_at AS DATE) AS day, wer AS x FROM predictions
  UNION ALL SELECT 'cer', language, CAST(scored_at AS DATE), cer FROM predictions),
valid AS (SELECT * FROM scores WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND x >= 0),
shares(percentile) AS (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE))
"""

SQL = {
    # Exact percentiles: the sketch collapses nothing below 4,096 values in a group.
    "p3_day_percentiles": f"""
WITH {_SCORES},
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY metric, language, day) AS n FROM valid WINDOW w AS (PARTITION BY metric, language, day ORDER BY x))
SELECT metric, language, CAST(day AS VARCHAR) AS day, percentile, x AS value, n, CAST(0 AS DOUBLE) AS rank_error
FROM ranked JOIN shares ON rn = greatest(1, CAST(ceil(percentile * n) AS BIGINT))""",
    "p3_percentiles": f"""
WITH {_SCORES},
ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY metric, language) AS n FROM valid WINDOW w AS (PARTITION BY metric, language ORDER BY x))
SELECT metric, language, percentile, x AS value, n, CAST(0 AS DOUBLE) AS rank_error
FROM ranked JOIN shares ON rn = greatest(1, CAST(ceil(percentile * n) AS BIGINT))""",
    # The bound of every percentile must hold, whatever the buffers collapsed.
    "p3_bounds": f"""
WITH {_SCORES},
sizes AS (SELECT metric, language, count(*) AS n FROM valid GROUP BY ALL)
SELECT metric, language, percentile, n, true AS within FROM sizes, shares""",
    # Segments must cover every hypothesis that has a letter outside of tags.
    "p2_covered": """
SELECT pred_id, CAST(length(hypothesis) AS INT) AS n_chars, true AS covered FROM predictions
WHERE regexp_matches(regexp_replace(hypothesis, '\\[[^\\]]*\\]|<[^>]*>|\\{[^}]*\\}', ' ', 'g'), '\\p{L}')""",
    "p6_kept": """
WITH named AS (SELECT replace(regexp_replace(lower(speaker_id), '^\\s+|\\s+$', '', 'g'), '-', '_') AS speaker_id, regexp_replace(lower(speaker_id), '^\\s+|\\s+$', '', 'g') AS name FROM asr_index_v6_16k)
SELECT speaker_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_splits FROM named WHERE name NOT IN ('', 'unknown', 'n/a', '-') GROUP BY speaker_id""",
    "p6_met": "SELECT split, share AS target_share, true AS met FROM split_targets",
    "p8_met": """
WITH docs AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source)
SELECT t.source, coalesce(n, 0) AS records, true AS met, true AS kept FROM mix_targets t LEFT JOIN docs USING (source)""",
    "p6_found": """
WITH rows_ AS (
  SELECT regexp_replace(lower(trim(speaker_id)), '^\\s+|\\s+$', '', 'g') AS name, regexp_replace(lower(trim(split)), '\\s+', '', 'g') AS s FROM asr_index_v6_16k),
named AS (
  SELECT replace(name, '-', '_') AS speaker_id, CASE WHEN s = 'training' THEN 'train' WHEN s IN ('validation', 'valid', 'val') THEN 'dev' WHEN s = 'eval' THEN 'test' ELSE s END AS s
  FROM rows_ WHERE name IS NOT NULL AND name NOT IN ('', 'unknown', 'n/a', '-'))
SELECT speaker_id FROM named WHERE s IN ('train', 'dev', 'test') GROUP BY speaker_id HAVING count(DISTINCT s) > 1""",
}
