"""Shared pieces of the SQL that states the queries for another engine."""

from __future__ import annotations

#: feat_1gram with cleaned keys, as in ``plans.tables.clean_features``.
FEATURES = r"""
f0 AS (
  SELECT row_id, loaded_at, feat_count, feat_freq, coalesce(ywui_wt, 1.0) AS weight,
    nullif(regexp_replace(trim(replace(yearweek_userid, '"', ''), ' '), '^(\d{4})_(\d)(:|$)', '\1_0\2\3'), '') AS group_id,
    nullif(regexp_replace(feat, '^[\s"]+|[\s"]+$', '', 'g'), '') AS term,
    nullif(regexp_replace(regexp_replace(yw, '^[\s"]+|[\s"]+$', '', 'g'), '^(\d{4})_(\d)$', '\1_0\2'), '') AS yw,
    nullif(regexp_replace(cnty, '^[\s"]+|[\s"]+$', '', 'g'), '') AS c0,
    nullif(regexp_replace(userid, '^[\s"]+|[\s"]+$', '', 'g'), '') AS userid
  FROM feat_1gram),
f AS (
  SELECT row_id, group_id, term, yw, userid, feat_count, feat_freq, weight,
    nullif(regexp_extract(group_id, '^(\d{4}_\d{2}):', 1), '') AS week_of_group,
    nullif(regexp_extract(group_id, '^[^:]*:(.+)$', 1), '') AS user_of_group,
    CASE WHEN c0 = '-1' THEN NULL WHEN length(c0) < 5 THEN lpad(c0, 5, '0') ELSE c0 END AS cnty,
    CAST(loaded_at AT TIME ZONE 'UTC' AS DATE) AS load_day,
    extract(hour FROM loaded_at AT TIME ZONE 'UTC') AS load_hour,
    coalesce(feat_freq > 0 AND feat_freq <= 1 AND NOT isnan(feat_freq), false) AS ok
  FROM f0)
"""

#: Start of a query over the cleaned feature table.
WITH_FEATURES = f"WITH {FEATURES}"
