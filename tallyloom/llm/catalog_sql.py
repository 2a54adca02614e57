"""SQL of the queries in ``llm.catalog``."""

from __future__ import annotations

from tallyloom.plans.sql import WITH_FEATURES

_TERMS = (
    WITH_FEATURES
    + """, n AS (SELECT count(DISTINCT group_id) AS n FROM f),
t AS (SELECT term AS feat, count(*) AS occurrences, round(sum(CASE WHEN feat_count IS NULL OR isnan(feat_count) THEN 0 ELSE feat_count END), 6) AS feat_count, count(DISTINCT group_id) AS user_weeks
  FROM f WHERE term IS NOT NULL AND group_id IS NOT NULL GROUP BY term),
marked AS (SELECT t.*, CASE WHEN user_weeks < 3 THEN 'rare' WHEN user_weeks > 0.05 * n THEN 'common' END AS mark FROM t, n)
"""
)


def _percentiles(levels: list[tuple[str, str, str, str, str]]) -> str:
    parts = [f"SELECT '{level}' AS level, {yw} AS yw, {cnty} AS cnty, {term} AS term, feat_freq AS x FROM f WHERE ok AND {where}" for level, yw, cnty, term, where in levels]
    return (
        WITH_FEATURES
        + ", rows AS ("
        + " UNION ALL ".join(parts)
        + """), ranked AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY level, yw, cnty, term) AS n FROM rows WINDOW w AS (PARTITION BY level, yw, cnty, term ORDER BY x)),
p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS percentile)
SELECT level, yw, cnty, term, percentile, n AS n_rows, x AS value FROM ranked JOIN p ON i = greatest(1, CAST(ceil(round(percentile * n, 6)) AS BIGINT))"""
    )


ORACLES = {
    # the tokenizer isn't known to SQL; that every text's tokens are in containers once and none is too full is
    "p8_check": """SELECT target_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text <> '' AND doc_id IS NOT NULL) AS n_documents,
  CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS wrong_documents FROM pack_targets""",
    "p1_distinct": WITH_FEATURES
    + """
SELECT 'userid' AS counted, concat_ws('+', CASE WHEN grouping(load_day) = 0 THEN 'day' END, CASE WHEN grouping(yw) = 0 THEN 'week' END, CASE WHEN grouping(cnty) = 0 THEN 'county' END) AS level,
  load_day, yw, cnty, count(DISTINCT userid) AS n_distinct
FROM f WHERE userid IS NOT NULL
GROUP BY GROUPING SETS ((load_day), (yw), (cnty), (load_day, yw), (load_day, cnty), (yw, cnty), (load_day, yw, cnty))
UNION ALL
SELECT 'cnty', CASE WHEN grouping(load_day) = 0 THEN 'day' ELSE 'week' END, load_day, yw, NULL, count(DISTINCT cnty) FROM f WHERE cnty IS NOT NULL GROUP BY GROUPING SETS ((load_day), (yw))""",
    "p2_terms": _TERMS + "SELECT * FROM marked",
    "p2_found": _TERMS + "SELECT feat, mark FROM marked WHERE mark IS NOT NULL",
    "p2_message_ngrams": """
WITH m AS (SELECT message_id, min(message) AS message FROM messages WHERE message IS NOT NULL GROUP BY 1),
w AS (SELECT message_id, regexp_extract_all(lower(message), '[\\p{L}\\p{N}_'']+') AS t FROM m),
g AS (SELECT message_id, n, array_to_string(t[i:i + n - 1], ' ') AS ngram FROM w, (SELECT unnest([1, 2, 3]) AS n), unnest(range(1, len(t) + 1)) AS u(i) WHERE i + n - 1 <= len(t))
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT message_id) AS records FROM g WHERE message_id IS NOT NULL GROUP BY 1, 2""".replace("\\\\", "\\"),
    "p4_percentiles": _percentiles(
        [("week", "yw", "NULL", "NULL", "yw IS NOT NULL"), ("county", "NULL", "cnty", "NULL", "cnty IS NOT NULL"), ("term", "NULL", "NULL", "term", "term IS NOT NULL")]
    ),
    "p4_percentiles_of_cells": _percentiles([("week+county+term", "yw", "cnty", "term", "yw IS NOT NULL AND cnty IS NOT NULL AND term IS NOT NULL")]),
}
