"""SQL of the queries in ``plans.exchange``: what was written, read from the tables."""

from __future__ import annotations

_M = "m AS (SELECT DISTINCT message_id, user_id, message, created_at, date2, date3 FROM messages)"
_ONE_LINE = _M + r""", o AS (SELECT * FROM m WHERE message IS NOT NULL AND NOT regexp_matches(message, '[\n\r\\]'))"""

ORACLES = {
    "messages_from_csv": "WITH "
    + _M
    + r""" SELECT nullif(message_id, 'NULL') AS message_id, nullif(user_id, 'NULL') AS user_id, nullif(regexp_replace(message, '\r\n?', chr(10), 'g'), 'NULL') AS message,
  nullif(created_at, 'NULL') AS created_at FROM m""",
    "messages_from_lines": f"WITH {_ONE_LINE} SELECT nullif(message_id, 'NULL') AS message_id, nullif(user_id, 'NULL') AS user_id, nullif(message, 'NULL') AS message FROM o",
    "rejected_records": "SELECT count(*) AS n_rejected, CAST(0 AS BIGINT) AS n_kept FROM nation",
    "messages_from_path_list": f"WITH {_ONE_LINE} SELECT user_id, count(*) AS n FROM o GROUP BY 1",
    "lexicon_from_csv": "SELECT term, category, max(weight) AS weight FROM lexicon WHERE term IS NOT NULL AND category IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2",
    "whitelist_words": "SELECT DISTINCT trim(term) AS word FROM lexicon WHERE trim(term) <> ''",
    "counties_from_csv": "SELECT CAST(fips AS VARCHAR) AS fips, state_name, region_name FROM county_dim",
    "loaded_features": "SELECT user_id, count(*) AS n, round(sum(weight), 6) AS weight FROM group_weight WHERE user_id IS NOT NULL AND weight IS NOT NULL GROUP BY 1",
    "appended_weights": "SELECT year_week, count(*) AS n, round(sum(weight), 6) AS weight FROM group_weight WHERE user_id IS NOT NULL AND year_week IS NOT NULL GROUP BY 1",
    "existing_output_refused": "SELECT r_name, true AS refused FROM region",
    "made_once": "SELECT region, count(*) AS n, CAST(1 AS INT) AS times_made FROM county_dim GROUP BY 1",
    "through_database": "SELECT state_abbr AS state, region, CAST(count(*) AS INT) AS n FROM county_dim GROUP BY 1, 2",
}
