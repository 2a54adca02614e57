"""SQL of the queries in ``plans.problems``."""

from __future__ import annotations

from tallyloom.plans.sql import WITH_FEATURES

_FLAGS = (
    WITH_FEATURES
    + r""",
readings AS (SELECT user_of_group AS u, feat_freq AS x FROM f WHERE ok AND user_of_group IS NOT NULL),
ranked AS (
  SELECT u, x, lag(x) OVER (PARTITION BY u ORDER BY x) AS before, row_number() OVER (PARTITION BY u ORDER BY x) - 1 AS below, count(*) OVER (PARTITION BY u) AS n
  FROM readings),
jumps AS (SELECT u, min(x) AS jump FROM ranked WHERE n >= 30 AND x >= 3 * before AND below * 2 >= n GROUP BY u),
steps AS (
  SELECT DISTINCT user_of_group AS u, term, week_of_group AS w, feat_freq AS x FROM f
  WHERE user_of_group IS NOT NULL AND term IS NOT NULL AND week_of_group IS NOT NULL AND feat_freq IS NOT NULL AND isfinite(feat_freq)),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY u, term ORDER BY w) AS i FROM steps),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY u, term, x ORDER BY w) AS run FROM placed),
stuck AS (SELECT u, term, w, x FROM (SELECT *, count(*) OVER (PARTITION BY u, term, x, run) AS len FROM runs) WHERE len >= 4),
flags AS (
  SELECT f.row_id, f.feat_freq IS NOT NULL AND NOT f.ok AS impossible, s.x IS NOT NULL AS stuck, coalesce(f.ok AND f.feat_freq >= j.jump, false) AS spike
  FROM f LEFT JOIN jumps j ON f.user_of_group = j.u
  LEFT JOIN stuck s ON f.user_of_group = s.u AND f.term = s.term AND f.week_of_group = s.w AND f.feat_freq = s.x)
"""
)

ORACLES = {
    "p5_found": _FLAGS + "SELECT row_id FROM flags WHERE impossible OR stuck OR spike",
    "p5_reasons": _FLAGS + "SELECT row_id, impossible, stuck, spike FROM flags WHERE impossible OR stuck OR spike",
    "p6_found": WITH_FEATURES
    + """, long AS (SELECT 'cnty' AS field_name, cnty AS key_value FROM f UNION ALL SELECT 'feat', term FROM f)
SELECT field_name, key_value FROM long WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) > 0.02 * (SELECT count(*) FROM f)""",
    "p6_report": WITH_FEATURES
    + """, long AS (SELECT 'cnty' AS field_name, cnty AS key_value, userid, feat_freq, ok FROM f UNION ALL SELECT 'feat', term, userid, feat_freq, ok FROM f)
SELECT field_name, key_value, count(*) AS n_rows, count(DISTINCT userid) AS n_members, count(*) FILTER (ok) AS n_valid,
  round(avg(feat_freq) FILTER (ok), 9) AS mean_value,
  quantile_disc(feat_freq, 0.25) FILTER (ok) AS q25, quantile_disc(feat_freq, 0.5) FILTER (ok) AS q50, quantile_disc(feat_freq, 0.75) FILTER (ok) AS q75,
  round(count(*) / (SELECT count(*) FROM f), 9) AS share, count(*) > 0.02 * (SELECT count(*) FROM f) AS hot
FROM long WHERE key_value IS NOT NULL GROUP BY ALL""",
}
