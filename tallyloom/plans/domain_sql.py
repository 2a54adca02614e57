"""SQL of the queries in ``plans.domain``; those that SQL can't state (look-ahead patterns, seeded shuffles, iterations) have none."""

from __future__ import annotations

from tallyloom.functions import text as X
from tallyloom.functions.numeric import INCOME_EDGES
from tallyloom.operators import weights as W
from tallyloom.operators.messages import STOP_WORDS
from tallyloom.operators.weights import TARGET_EDGES, TARGET_SHARES
from tallyloom.plans.sql import FEATURES


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


MESSAGES = "m AS (SELECT DISTINCT message_id, user_id, message, created_at, date2, date3, lang FROM messages)"
_TS = "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN try_strptime(trim({c}), '%Y-%m-%d %H:%M:%S') END" for c in ("created_at", "date2", "date3")) + ")"
KEYED = f"{MESSAGES}, k0 AS (SELECT *, {_TS} AS ts FROM m), keyed AS (SELECT *, coalesce(strftime(ts, '%G_%V'), '') || ':' || user_id AS group_id FROM k0 WHERE user_id IS NOT NULL AND trim(user_id) <> '' AND message IS NOT NULL)"
FEATURE_TABLE = (
    FEATURES
    + """, ft AS (
  SELECT group_id, feat, sum(value) AS value, sum(group_norm) AS group_norm FROM (
    SELECT DISTINCT group_id, term AS feat, feat_count AS value, feat_freq AS group_norm FROM f
    WHERE group_id IS NOT NULL AND term IS NOT NULL AND term NOT LIKE '@%' AND ok AND feat_count > 0 AND NOT isnan(feat_count))
  GROUP BY 1, 2)"""
)
LEXICON = "lw AS (SELECT term, category, max(weight) AS weight FROM lexicon WHERE term IS NOT NULL AND category IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2), ic AS (SELECT category, weight AS intercept FROM lw WHERE term = '_intercept')"
MATCHED = """got AS (SELECT group_id, category, sum(value) AS value, sum(group_norm * weight) AS s, sum(value * weight) AS wv FROM ft JOIN lw ON ft.feat = lw.term WHERE lw.term <> '_intercept' GROUP BY 1, 2)"""
SCORES = (
    FEATURE_TABLE
    + ", "
    + LEXICON
    + ", "
    + MATCHED
    + """, every AS (SELECT DISTINCT group_id, category FROM ft, ic),
sc AS (SELECT coalesce(e.group_id, g.group_id) AS group_id, coalesce(e.category, g.category) AS category, coalesce(value, 0) AS value, coalesce(s, 0) + coalesce(ic.intercept, 0) AS score
  FROM every e FULL JOIN got g ON e.group_id = g.group_id AND e.category = g.category LEFT JOIN ic ON ic.category = coalesce(e.category, g.category)),
sf AS (SELECT group_id, category AS feat, value, score AS group_norm, split_part(group_id, ':', 1) AS yw FROM sc)"""
)
COUNTIES = "uc AS (SELECT CAST(user_id AS VARCHAR) AS entity, lpad(CAST(max(cnty) AS VARCHAR), 5, '0') AS cnty FROM user_county WHERE user_id IS NOT NULL AND cnty IS NOT NULL GROUP BY 1)"
WEIGHTS = r"""gw AS (SELECT g AS group_id, max(weight) AS weight FROM (SELECT nullif(regexp_replace(trim(replace(user_id, '"', '')), '^(\d{4})_(\d)(:|$)', '\1_0\2\3'), '') AS g, weight FROM group_weight) WHERE g IS NOT NULL AND g NOT LIKE ':%' AND weight IS NOT NULL GROUP BY 1)"""
ENTITY = "nullif(substr(group_id, strpos(group_id, ':') + 1), '')"
PLACED = (
    SCORES
    + f""", {COUNTIES}, {WEIGHTS},
located AS (SELECT s.*, uc.cnty, {ENTITY.replace('group_id', 's.group_id')} AS u FROM sf s JOIN uc ON uc.entity = {ENTITY.replace('group_id', 's.group_id')}),
placed AS (SELECT l.group_id, l.u, feat, value, least(greatest(group_norm, 0), 5) AS group_norm, cnty, coalesce(gw.weight, 1) AS weight FROM located l LEFT JOIN gw ON gw.group_id = l.group_id WHERE l.group_id NOT LIKE ':%' AND value > 0)"""
)
WEEK = r"CASE WHEN regexp_matches(group_id, '^\d{4}_\d{2}:') THEN substr(group_id, 1, 7) END"
MONDAY = "CAST(date_trunc('week', make_date(CAST(substr({w}, 1, 4) AS INT), 1, 4)) AS DATE) + 7 * (CAST(substr({w}, 6, 2) AS INT) - 1)"
THURSDAY = f"({MONDAY} + 3)"
GRAIN = {"week": WEEK, "month": "strftime(" + MONDAY.format(w=f"({WEEK})") + ", '%Y_%m')", "year": f"substr({WEEK}, 1, 4)"}


def places(grain: str = "week") -> str:
    return (
        PLACED
        + f""", pk AS (SELECT ({GRAIN[grain]}) || ':' || cnty AS key, * FROM placed),
pl AS (SELECT key, feat, sum(value) AS sum_N_lexwords, sum(group_norm * weight) / sum(weight) AS wavg_score, avg(group_norm) AS avg_score, stddev_pop(group_norm) AS std_score,
  sqrt(greatest(sum(group_norm * group_norm * weight) / sum(weight) - pow(sum(group_norm * weight) / sum(weight), 2), 0)) AS wstd_score,
  count(DISTINCT u) AS N_users, split_part(key, ':', 2) AS Space, split_part(key, ':', 1) AS Time FROM pk WHERE key IS NOT NULL GROUP BY key, feat)"""
    )


PANEL = (
    places()
    + """, dim AS (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') AS cnty, state_abbr, region, region_name, division FROM county_dim),
panel AS (SELECT w.*, dim.* EXCLUDE (cnty) FROM (SELECT Space AS cnty, Time AS yw, max(wavg_score) FILTER (feat = 'DEP_SCORE') AS dep, max(wavg_score) FILTER (feat = 'ANX_SCORE') AS anx, max(wavg_score) FILTER (feat = 'ANG_SCORE') AS ang, max(N_users) AS n_users FROM pl GROUP BY 1, 2) w JOIN dim ON dim.cnty = w.cnty)"""
)
_PLACE_OUT = " SELECT key, feat, round(sum_N_lexwords, 6) AS sum_N_lexwords, round(wavg_score, 6) AS wavg_score, round(avg_score, 6) AS avg_score, round(std_score, 4) AS std_score, round(wstd_score, 4) AS wstd_score, N_users, Space, Time FROM pl"
INCOMES = """inc AS (SELECT user_id, year_week AS yw, cnty, exp(8.6 + ln(weight) + (CAST(split_part(user_id, ':', -1) AS BIGINT) % 97) / 24.0) AS income
  FROM (SELECT user_id, year_week, max(cnty) AS cnty, max(weight) AS weight FROM group_weight GROUP BY 1, 2) WHERE cnty IS NOT NULL AND weight > 0)"""
_RAW = [f"(1 + (fips * {i + 3}) % 11)" for i in range(10)]
CENSUS = "cen AS (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') AS cnty, unnest(range(0, 10)) AS bin, unnest([" + ", ".join(f"100.0 * {r} / ({' + '.join(_RAW)})" for r in _RAW) + "]) AS pct FROM county_dim)"
INCOME_BIN = "CASE " + " ".join(f"WHEN {{x}} < {e} THEN {i}" for i, e in enumerate(INCOME_EDGES, 1)) + " ELSE 10 END"


def poststratified(p: str) -> str:
    bin0 = f"{INCOME_BIN.format(x='income')} - 1"
    return f"""WITH {INCOMES}, {CENSUS},
b AS (SELECT *, {bin0} AS bin FROM inc), n AS (SELECT cnty, yw, bin, count(*) AS n FROM b GROUP BY 1, 2, 3), t AS (SELECT cnty, yw, count(*) AS t FROM b GROUP BY 1, 2)
SELECT user_id, b.cnty, b.yw, round(CASE WHEN {p} > 0 THEN pct / (100 * {p}) ELSE 0 END, 6) AS weight
FROM b JOIN n USING (cnty, yw, bin) JOIN t USING (cnty, yw) JOIN cen USING (cnty, bin)"""


SPOKEN = "(SELECT * FROM keyed WHERE message <> '')"
WRITTEN = "(SELECT * FROM documents WHERE text <> '' AND source <> '')"


def whitespace(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def ngram_counts(source: str, group: str, tokens: str, sizes: str, lower: bool = True) -> str:
    g = "lower(array_to_string(t[i:i + n - 1], ' '))"
    return f"""tk AS (SELECT {group} AS group_id, {tokens} AS t FROM {source}),
g AS (SELECT group_id, n, {g} AS feat FROM tk, (SELECT unnest([{sizes}]) AS n), unnest(range(1, len(t) + 1)) AS u(i) WHERE i + n - 1 <= len(t)),
c AS (SELECT group_id, n, feat, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY 1, 2, 3),
cn AS (SELECT *, value / sum(value) OVER (PARTITION BY group_id, n) AS group_norm FROM c)"""


TOKENS = f"list_transform(regexp_extract_all(message, {quoted(X.TOKEN)}), lambda x: CASE WHEN regexp_matches(x, {quoted('(?i)' + X.EMOTICON)}) THEN x ELSE lower(x) END)"
# as a yes-or-no question the link pattern needs no look-ahead: after a scheme, www. or a domain and a sign, a link always ends somewhere
HAS_LINK = rf"{X.BARE_LINK}|\b(?:https?://|www\.|[a-z0-9.\-]+?\.{X.TOP_LEVEL}[^A-Za-z0-9_])"
_STOP = {l: "len(list_filter(t, lambda x: x IN (" + ", ".join(quoted(w) for w in dict.fromkeys(ws)) + ")))" for l, ws in sorted(STOP_WORDS.items())}
# the entities of the message table
DECODED = "message"
for _entity, _sign in (("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'")):
    DECODED = f"replace({DECODED}, {quoted(_entity)}, {quoted(_sign)})"
# links, put in groups so that what a look-ahead would leave in place is given back: RE2 has none
_BODY = r"[^ \t\r\n<>]*?"
_DOMAIN = rf"[a-z0-9.\-]+?\.{X.TOP_LEVEL}"
_LINK_GROUPS = rf"{X.BARE_LINK}|\b(?:(?:https?://|www\.){_BODY}|{_DOMAIN}[^A-Za-z0-9_ \t\r\n<>]{_BODY}|{_DOMAIN})({X.CRAP_BEFORE_END}{X.LINK_END})"


def anonymized(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {quoted(_LINK_GROUPS)}, '<URL>\\1', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '<USER>', 'g')"


def tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {quoted(X.TOKEN)}), lambda x: CASE WHEN regexp_matches(x, {quoted('(?i)' + X.EMOTICON)}) THEN x ELSE lower(x) END)"


def duplicate_key(c: str) -> str:
    """The key from an anonymized text's tokens t."""
    return f"CASE WHEN len({c}) >= {X.KEY_WORDS} THEN array_to_string({c}[1:CASE WHEN list_contains({c}, '{X.VIDEO_SITE}') THEN {X.KEY_WORDS_VIDEO} ELSE {X.KEY_WORDS} END], ' ') ELSE lower(array_to_string({c}, ' ')) END"


def _counted_words(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '@') AND NOT regexp_matches(x, {quoted(X.EXCLUDED_WORD)}))"


def keys_of(source: str, message: str = "message") -> str:
    """dk: the rows of source with their duplicate key."""
    return f"dk0 AS (SELECT *, {_counted_words(anonymized(message))} AS kw FROM {source}), dk AS (SELECT * EXCLUDE (kw), {duplicate_key('kw')} AS dkey FROM dk0)"


def first_of_duplicates(group: str) -> str:
    return f"SELECT * EXCLUDE (dkey) FROM dk QUALIFY row_number() OVER (PARTITION BY {group}, dkey ORDER BY message_id NULLS FIRST, created_at NULLS FIRST) = 1"


_STRIPPED = "regexp_replace(regexp_replace({c}, '^\"', ''), '\"$', '')"


def cleaned(source: str, group: str) -> str:
    """cl: rows of source cleaned as clean_messages does, group and message without a stray pair of quotes."""
    g, m = _STRIPPED.format(c=group), _STRIPPED.format(c="message")
    return f"""c0 AS (SELECT * REPLACE ({g} AS {group}, {m} AS message) FROM {source} WHERE message IS NOT NULL AND {group} IS NOT NULL AND message <> 'message'),
c1 AS (SELECT * FROM c0 WHERE NOT starts_with(message, 'RT ') AND NOT regexp_matches(message, {quoted(HAS_LINK)})), {keys_of('c1')}, cl AS ({first_of_duplicates(group)})"""


def scores_of(ft: str) -> str:
    """sc of a feature table given as CTEs that end in ft."""
    return ft + ", " + SCORES.removeprefix(FEATURE_TABLE + ", ")


_CUM = [sum(TARGET_SHARES[: i + 1]) for i in range(len(TARGET_SHARES) - 1)]

MONTH_KEY = f"({GRAIN['month']}) || ':' || cnty"


def effects(feat: str, key: str, value: str, measure: str = "d", name: str = "key", splits: int = 30, thresholds: tuple = (3,), last: str | None = None) -> str:
    """Split-half effects with halves by the digits of the id's md5."""
    angle = "asin(sqrt(CASE WHEN {x} >= 0 AND {x} <= 1 THEN {x} END))"
    each = f"abs(2 * ({angle.format(x='a')} - {angle.format(x='b')}))" if measure == "h" else "abs(a - b) / nullif(sd, 0)"
    ok = "true" if measure == "h" and splits == 1 else "sd > 0"
    last = last or f"SELECT {name}, threshold, n, round(effect, 6) AS effect, round(effect_se, 6) AS effect_se, reliable FROM ef"
    return f"""WITH {PLACED}, r AS (SELECT {key} AS k, {value} AS v, md5(group_id) AS i FROM placed WHERE feat = {feat}), g AS (SELECT k, count(*) AS n, stddev_pop(v) AS sd FROM r WHERE k IS NOT NULL GROUP BY 1),
h AS (SELECT k, p, avg(v) FILTER (i[p:p] < '8') AS a, avg(v) FILTER (NOT i[p:p] < '8') AS b FROM r, (SELECT unnest(range(1, {splits + 1})) AS p) GROUP BY 1, 2),
e AS (SELECT h.k, n, CASE WHEN {ok} THEN {each} END AS d FROM h JOIN g ON g.k = h.k),
t AS (SELECT unnest([{', '.join(map(str, thresholds))}]) AS threshold),
s AS (SELECT k, threshold, n, CASE WHEN n >= greatest(threshold, 2) THEN avg(d) END AS effect, CASE WHEN n >= greatest(threshold, 2) THEN stddev_pop(d) / sqrt(count(d)) END AS effect_se FROM e, t GROUP BY 1, 2, 3),
ef AS (SELECT k AS {name}, CAST(threshold AS INT) AS threshold, n, effect, effect_se, coalesce(effect + 1.96 * effect_se < 0.1, false) AS reliable FROM s)
{last}"""


def coefficients(rows: str, key: str) -> str:
    return f"""WITH {PANEL}, q AS ({rows}),
s AS (SELECT k, regr_count(y, x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS mx FROM q WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY k),
e AS (SELECT *, CASE WHEN n > 2 THEN greatest(syy - b * sxy, 0) / (n - 2) END AS mse FROM s)
SELECT k AS {key}, n, CASE WHEN sxx > 0 THEN round(b, 6) END AS slope, CASE WHEN sxx > 0 THEN round(a, 6) END AS intercept, CASE WHEN sxx > 0 AND syy > 0 THEN round(r2, 6) END AS r2, round(sqrt(mse / nullif(sxx, 0)), 6) AS slope_se,
  round(sqrt(mse * (1 / n + mx * mx / nullif(sxx, 0))), 6) AS intercept_se, round(b / nullif(sqrt(mse / nullif(sxx, 0)), 0), 4) AS slope_t FROM e"""


def poststratified_by(name: str, edges: tuple) -> str:
    """Weights of one of the other demographics, with ten pseudo-users a county; the last bin has what the others leave."""
    m = len(edges) - 1
    raw = [f"(1 + (fips * {i + 3}) % 11)" for i in range(m)]
    pct = [f"100.0 * {r} / ({' + '.join(raw)})" for r in raw]
    place = "CASE " + " ".join(f"WHEN {name} < {edges[b + 1]} THEN {b}" for b in range(m)) + " END"
    return f"""WITH u AS (SELECT user_id, year_week AS yw, max(cnty) AS cnty, CAST(split_part(user_id, ':', -1) AS BIGINT) AS k FROM group_weight GROUP BY ALL HAVING max(cnty) IS NOT NULL),
v AS (SELECT user_id, yw, cnty, CAST(13 + k * 7 % 68 AS DOUBLE) AS age, k % 2 * 1.0::DOUBLE AS gender, k % 3 / 2.0::DOUBLE AS education FROM u),
b AS (SELECT *, {place} AS bin FROM v), n AS (SELECT cnty, yw, bin, count(*) AS n FROM b GROUP BY 1, 2, 3), t AS (SELECT cnty, yw, count(*) AS t FROM b GROUP BY 1, 2),
cen AS (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') AS cnty, unnest(range(0, {m})) AS bin, unnest([{', '.join(pct)}]) AS pct FROM county_dim)
SELECT b.user_id, b.cnty, b.yw, round(pct / (100 * (n + 10 * pct / 100) / (t + 10)), 6) AS weight FROM b JOIN n USING (cnty, yw, bin) JOIN t USING (cnty, yw) JOIN cen USING (cnty, bin)"""


def _tidy(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s:]+|[\\s:]+$', '', 'g')"


def _found(c: str, pattern: str) -> str:
    return f"regexp_extract({c}, {quoted('(?s)' + pattern)}, 1)"


#: sh: messages with the shared part and the comment on it.
SHARED = f"""{MESSAGES}, s0 AS (SELECT *, regexp_matches(message, {quoted(X.SHARED_FROM)}) AS has_rt, {_found('message', f'^(.*?){X.SHARED_FROM}')} AS before, {_found('message', f'^.*?{X.SHARED_FROM}(.*)$')} AS after,
  regexp_matches(message, {quoted(X.SHARED_START)}) AND regexp_matches(message, {quoted(X.ANY_USER)}) AS plain,
  CASE WHEN regexp_matches(message, {quoted(X.VIA_IN_BRACKETS)}) THEN 1 WHEN regexp_matches(message, {quoted(X.VIA)}) THEN 2 END AS via FROM m WHERE message IS NOT NULL),
s1 AS (SELECT *, CASE via WHEN 1 THEN {_found('message', f'^(.*?){X.VIA_IN_BRACKETS}')} WHEN 2 THEN {_found('message', f'^(.*?){X.VIA}')} END AS head,
  CASE via WHEN 1 THEN {_found('message', f'^.*?{X.VIA_IN_BRACKETS}(.*)$')} WHEN 2 THEN {_found('message', f'^.*?{X.VIA}(.*)$')} END AS tail FROM s0),
s2 AS (SELECT *, {_found('tail', '[[](.*)[]]')} AS bracket FROM s1),
sh AS (SELECT message_id, user_id,
  CASE WHEN via IS NOT NULL THEN trim(CASE WHEN head = '' THEN CASE WHEN bracket <> '' THEN {_tidy(_found('tail', '^(.*?)[[]'))} ELSE '' END ELSE regexp_replace(trim(head), '[|,./]$', '') END)
    WHEN has_rt AND after = '' THEN {_tidy('before')} WHEN has_rt THEN {_tidy('after')} WHEN plain THEN {_found('message', f'{X.ANY_USER}(.*)$')} ELSE '' END AS shared,
  CASE WHEN via IS NOT NULL THEN trim(CASE WHEN head = '' THEN bracket ELSE regexp_replace(trim(tail), '^:', '') END)
    WHEN has_rt AND after = '' THEN '' WHEN has_rt THEN {_tidy('before')} WHEN plain THEN {_found('message', f'{X.SHARED_START}(.*?){X.ANY_USER}')} ELSE '' END AS comment FROM s2)"""


def collapsed_weights(least: float, smooth_first: bool) -> str:
    """Weights with small bins merged, step by step, over the bin counts of each county and week."""
    bin0 = f"{INCOME_BIN.format(x='income')} - 1"
    counts = ", ".join(f"CAST(count(*) FILTER (bin = {i}) AS DOUBLE)" for i in range(10))
    edges = "[" + ", ".join("'inf'::DOUBLE" if e == float("inf") else f"{e}::DOUBLE" for e in W.INCOME.edges) + "]"
    first = "list_transform(range(1, 11), lambda j: c[j] + 10 * pct[j] / 100)" if smooth_first else "c"
    share = "round_even(x, 0) / t" if smooth_first else "(round_even(x, 0) + 10 * p / 100) / (t + 10)"
    return f"""WITH RECURSIVE {INCOMES}, {CENSUS}, b AS (SELECT *, {bin0} AS bin FROM inc),
n AS (SELECT cnty, yw, count(*) AS t, [{counts}] AS c FROM b GROUP BY 1, 2), cp AS (SELECT cnty, list(pct ORDER BY bin) AS pct FROM cen GROUP BY 1),
r AS (SELECT cnty, yw, t, pct, {first} AS c, {edges} AS e FROM n JOIN cp USING (cnty)
  UNION ALL
  SELECT cnty, yw, t, pct, CASE WHEN toright THEN c[1:i - 1] || [c[i] + c[i + 1]] || c[i + 2:] ELSE c[1:i - 2] || [c[i - 1] + c[i]] || c[i + 1:] END,
    CASE WHEN toright THEN e[1:i] || e[i + 2:] ELSE e[1:i - 1] || e[i + 1:] END
  FROM (SELECT *, i = 1 OR (i < len(c) AND c[i + 1] <= c[i - 1]) AS toright FROM (SELECT *, list_position(c, list_min(c)) AS i FROM r WHERE len(c) > 1 AND list_min(c) < {least}))),
f AS (SELECT * FROM r WHERE len(c) = 1 OR list_min(c) >= {least}),
q AS (SELECT *, list_transform(range(1, len(c)), lambda j: coalesce(list_sum(list_transform(range(1, 11), lambda o: CASE WHEN e[j] <= {edges}[o] AND {edges}[o] < e[j + 1] THEN pct[o] ELSE 0 END)), 0)) AS head FROM f),
w AS (SELECT cnty, yw, t, c, e, head || [100 - coalesce(list_sum(head), 0)] AS bp FROM q),
u AS (SELECT user_id, inc.cnty, inc.yw, t, len(c) AS k, len(list_filter(e[2:], lambda x: x <= income)) + 1 AS place, c, bp FROM inc JOIN w ON inc.cnty = w.cnty AND inc.yw = w.yw),
v AS (SELECT *, c[place] AS x, bp[place] AS p FROM u)
SELECT user_id, cnty, yw, round(CASE WHEN k = 1 THEN 1.0 WHEN place <= k THEN CASE WHEN {share} > 0 THEN p / (100 * ({share})) ELSE 0 END END, 6) AS weight FROM v"""


ORACLES: dict[str, str] = {
    "shared_parts": f"WITH {SHARED} SELECT message_id, shared, comment FROM sh WHERE shared <> ''",
    "originals": f"WITH {SHARED} SELECT user_id, count(*) AS n FROM sh WHERE shared = '' GROUP BY 1",
    "poststratified_min_bin": collapsed_weights(2, False),
    "poststratified_smooth_first": collapsed_weights(2, True),
    "message_tokens": f"WITH {MESSAGES}, t AS (SELECT message_id, {TOKENS} AS t FROM m WHERE message IS NOT NULL), e AS (SELECT unnest(t) AS token, unnest(range(0, len(t))) AS place FROM t) SELECT token, count(*) AS n, CAST(min(place) AS INT) AS first_place FROM e GROUP BY 1",
    "whitespace_tokens": f"WITH {MESSAGES} SELECT token, count(*) AS n FROM (SELECT unnest({whitespace('message')}) AS token FROM m WHERE message IS NOT NULL) GROUP BY 1",
    "tagged_word_tokens": f"WITH {MESSAGES} SELECT 'L' || CAST(least(length(token), 9) AS VARCHAR) AS tag, count(*) AS n FROM (SELECT unnest({whitespace('message')}) AS token FROM m WHERE message IS NOT NULL) GROUP BY 1",
    "dependency_tokens": "SELECT token, count(*) AS n FROM (SELECT state_abbr || ' ' || region_name || ' ' || division_name AS token FROM county_dim UNION ALL SELECT 'in ' || state_name || ' ' || state_abbr FROM county_dim) GROUP BY 1",
    "filter_shared_and_links": f"WITH {MESSAGES} SELECT message_id FROM m WHERE NOT starts_with(message, 'RT ') AND NOT regexp_matches(message, {quoted(HAS_LINK)})",
    "iso_week_users": f"WITH {KEYED} SELECT group_id, count(*) AS n_posts FROM keyed GROUP BY 1",
    "mixed_week_users": f"WITH {MESSAGES}, k AS (SELECT coalesce(strftime({_TS}, '%Y_%V'), '') || ':' || user_id AS group_id FROM m WHERE user_id IS NOT NULL AND trim(user_id) <> '') SELECT group_id, count(*) AS n_posts FROM k GROUP BY 1",
    "posts_by_date": f"WITH {MESSAGES} SELECT day, count(*) AS n_posts FROM (SELECT nullif(regexp_extract(created_at, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS day FROM m) WHERE day IS NOT NULL GROUP BY 1",
    "unpadded_week_users": f"""WITH {MESSAGES}, x AS (SELECT user_id, regexp_extract(created_at, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS x FROM m WHERE user_id IS NOT NULL), d AS (SELECT user_id, try_strptime(x, '%Y-%m-%d') AS d FROM x WHERE x <> ''),
w AS (SELECT user_id, d, CAST(floor((dayofyear(d) - 1 + dayofweek(date_trunc('year', d))) / 7) AS INT) + 1 AS w, d + to_days(CAST(6 - dayofweek(d) AS INT)) >= date_trunc('year', d) + INTERVAL 1 YEAR AS rolls FROM d)
SELECT CASE WHEN d IS NULL THEN user_id ELSE year(d) || '_' || CASE WHEN rolls THEN 1 ELSE w END || ':' || user_id END AS group_id, count(*) AS n_posts FROM w GROUP BY 1""",
    "shrunk_messages": f"WITH {MESSAGES}, a AS (SELECT message_id, regexp_replace(regexp_replace(message, '\\s\\s+', ' ', 'g'), '\\.{{5,}}', '....', 'g') AS x FROM m WHERE message IS NOT NULL) SELECT message_id, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s*\\n\\s*', ' <NEWLINE> ', 'g') AS message FROM a",
    "decoded_messages": f"WITH {MESSAGES} SELECT message_id, regexp_replace({DECODED}, '\\\\x[0-9a-z]{{1,4}}', ' ', 'g') AS message FROM m WHERE message IS NOT NULL",
    "posting_threshold": f"WITH {KEYED} SELECT group_id, message_id FROM keyed QUALIFY count(*) OVER (PARTITION BY group_id) >= 3",
    "language_filter": f"""WITH {MESSAGES}, u AS (SELECT message_id, trim({DECODED}) AS x FROM m WHERE message IS NOT NULL),
p AS (SELECT message_id, regexp_extract_all(lower(trim(regexp_replace(x, '(?:#|@)\\S+|https?://\\S+|www\\.\\S+', ' ', 'g'))), '[\\p{{L}}'']+') AS t FROM u WHERE x <> '' AND x <> 'NULL'),
n AS (SELECT message_id, {", ".join(f"{c} AS {l}" for l, c in _STOP.items())} FROM p)
SELECT message_id, 'en' AS lang, round(en / ({" + ".join(_STOP)}), 8) AS confidence FROM n WHERE en > greatest(de, 0) AND en >= greatest(es, fr, pt) AND en / ({" + ".join(_STOP)}) > 0.8""",
    "ngrams_1": f"WITH {KEYED}, {ngram_counts(SPOKEN, 'group_id', TOKENS, '1')} SELECT group_id, feat, value, round(group_norm, 6) AS group_norm FROM cn",
    "ngrams_1_to_3_by_source": f"WITH {ngram_counts(WRITTEN, 'source', whitespace('text'), '1, 2, 3')} SELECT group_id, CAST(n AS INT) AS n, feat, value, round(group_norm, 6) AS group_norm FROM cn",
    "ngrams_min_value": f"WITH {KEYED}, {ngram_counts(SPOKEN, 'user_id', whitespace('message'), '2')} SELECT group_id, feat, value, round(group_norm, 6) AS group_norm FROM cn WHERE value >= 3",
    "ngrams_binary": f"WITH {KEYED}, {ngram_counts(SPOKEN, 'user_id', whitespace('message'), '1')} SELECT group_id, feat, value, 1.0::DOUBLE AS group_norm FROM cn",
    "ngrams_whitelist": f"""WITH {KEYED}, v AS (SELECT DISTINCT term FROM lexicon WHERE term IS NOT NULL),
tk AS (SELECT user_id AS group_id, {whitespace('lower(message)')} AS t FROM keyed WHERE message <> ''),
p AS (SELECT group_id, t[i] AS a, t[i + 1] AS b FROM tk, unnest(range(1, len(t))) AS u(i)),
g AS (SELECT group_id, CASE WHEN a IN (SELECT term FROM v) AND b IN (SELECT term FROM v) THEN a || ' ' || b ELSE '<oov_2gram>' END AS feat FROM p),
c AS (SELECT group_id, feat, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY 1, 2) SELECT group_id, feat, value, round(value / sum(value) OVER (PARTITION BY group_id), 6) AS group_norm FROM c""",
    "group_norms": f"WITH {FEATURE_TABLE} SELECT group_id, feat, value, round(value / sum(value) OVER (PARTITION BY group_id), 6) AS group_norm FROM ft",
    "repeated_features_compat": f"WITH {FEATURES} SELECT group_id, term AS feat, feat_count AS value, feat_freq AS group_norm FROM f WHERE group_id IS NOT NULL AND term IS NOT NULL AND feat_count > 0 AND NOT isnan(feat_count) AND ok QUALIFY row_number() OVER (PARTITION BY group_id, term ORDER BY feat_count DESC, feat_freq DESC) = 1",
    "rare_features_folded": f"""WITH {FEATURE_TABLE}, df AS (SELECT feat, count(*) AS n FROM ft GROUP BY 1), th AS (SELECT CAST(floor(0.01 * count(DISTINCT group_id)) AS BIGINT) AS t FROM ft),
mk AS (SELECT ft.*, n < t AS rare FROM ft JOIN df USING (feat), th)
SELECT group_id, feat, round(value, 6) AS value, round(group_norm, 6) AS group_norm FROM mk WHERE NOT rare
UNION ALL SELECT group_id, '<OOV>', round(coalesce(sum(value) FILTER (rare), 0), 6), round(coalesce(sum(group_norm) FILTER (rare), 0), 6) FROM mk GROUP BY 1""",
    "document_frequencies": f"WITH {FEATURE_TABLE} SELECT feat, count(*) AS n_groups FROM ft GROUP BY 1",
    "anscombe": f"""WITH {FEATURE_TABLE}, a AS (SELECT group_id, regexp_replace(feat, '[^A-Za-z0-9_\\s]', '', 'g') AS feat, 2 * sqrt(value + 0.375) AS value FROM ft WHERE group_id >= '2020_01' AND group_id < '2021_01')
SELECT group_id, feat, round(value, 6) AS value, round(value / sum(value) OVER (PARTITION BY group_id), 6) AS group_norm FROM a WHERE trim(feat) <> ''""",
    "vocabulary_filter": f"WITH {FEATURE_TABLE} SELECT group_id, feat, round(value, 6) AS value FROM ft WHERE group_id NOT LIKE ':%' AND group_id NOT LIKE '%:' AND feat IN (SELECT term FROM lexicon)",
    "lexicon_last_weights": f"WITH {LEXICON} SELECT term, category, weight FROM lw",
    "lexicon_scores": f"WITH {SCORES} SELECT group_id, category, round(value, 6) AS value, round(score, 6) + 0.0 AS score FROM sc",
    "lexicon_scores_matched": f"WITH {FEATURE_TABLE}, {LEXICON}, {MATCHED} SELECT group_id, got.category, round(value, 6) AS value, round(s + coalesce(intercept, 0), 6) + 0.0 AS score, round(wv, 6) + 0.0 AS weighted_value FROM got LEFT JOIN ic ON ic.category = got.category",
    "category_counts": f"WITH {FEATURE_TABLE}, {LEXICON}, {MATCHED} SELECT group_id, category, round(value, 6) AS value FROM got",
    "clamped_scores": f"WITH {SCORES} SELECT group_id, feat, round(least(greatest(group_norm, 0), 5), 6) AS group_norm FROM sf WHERE feat IN ('DEP_SCORE', 'ANX_SCORE', 'ANG_SCORE')",
    "standardized_scores": f"WITH {SCORES}, c AS (SELECT group_id, feat, least(greatest(group_norm, 0), 5) AS x FROM sf) SELECT group_id, feat, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 6) + 0.0 AS group_norm FROM c WINDOW w AS (PARTITION BY feat)",
    "recentered_scores": f"WITH {SCORES}, c AS (SELECT group_id, feat, least(greatest(group_norm, 0), 5) AS x FROM sf), z AS (SELECT group_id, feat, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) + avg(x) OVER w AS x FROM c WINDOW w AS (PARTITION BY feat)) SELECT group_id, feat, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, 0), 5) END, 6) AS group_norm FROM z",
    "week_bounds": f"WITH {SCORES}, b AS (SELECT yw, feat, avg(group_norm) AS mean, stddev_pop(group_norm) AS sd FROM sf GROUP BY 1, 2) SELECT yw, feat, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(mean - 3 * sd, 6) + 0.0 AS low, round(mean + 3 * sd, 6) + 0.0 AS high FROM b",
    "sigma_reset": f"WITH {SCORES}, b AS (SELECT *, avg(group_norm) OVER w AS mean, stddev_pop(group_norm) OVER w AS sd FROM sf WHERE yw <> '' WINDOW w AS (PARTITION BY yw, feat)) SELECT group_id, feat, round(CASE WHEN group_norm < mean - 3 * sd OR group_norm > mean + 3 * sd THEN mean ELSE group_norm END, 6) + 0.0 AS group_norm FROM b",
    "min_max_scores": f"WITH {SCORES}, e AS (SELECT min(group_norm) AS lo, max(group_norm) AS hi FROM sf) SELECT group_id, feat, round((group_norm - lo) / (hi - lo) * 5.0 + 0.0, 3) AS group_norm FROM sf, e",
    "with_county": f"WITH {FEATURE_TABLE}, {COUNTIES} SELECT group_id, feat, round(value, 6) AS value, cnty FROM ft JOIN uc ON uc.entity = {ENTITY}",
    "without_county": f"WITH {FEATURE_TABLE}, {COUNTIES} SELECT group_id, feat, round(value, 6) AS value FROM ft ANTI JOIN uc ON uc.entity = {ENTITY}",
    "with_weight": f"WITH {FEATURE_TABLE}, {WEIGHTS} SELECT group_id, feat, round(value, 6) AS value, round(coalesce(weight, 1), 6) AS weight FROM ft LEFT JOIN gw USING (group_id) WHERE group_id NOT LIKE ':%'",
    "reweighted": f"WITH {FEATURE_TABLE}, {WEIGHTS} SELECT group_id, feat, round(value * coalesce(weight, 1), 6) AS value, round(group_norm * coalesce(weight, 1), 6) AS group_norm FROM ft LEFT JOIN gw USING (group_id)",
    "reweighted_matched": f"WITH {FEATURE_TABLE}, {WEIGHTS} SELECT group_id, feat, round(value * weight, 6) AS value, round(group_norm * weight, 6) AS group_norm FROM ft JOIN gw USING (group_id)",
    "not_reweighted": f"WITH {FEATURE_TABLE}, {WEIGHTS} SELECT group_id, feat, round(value, 6) AS value, round(group_norm, 6) AS group_norm FROM ft ANTI JOIN gw USING (group_id)",
    "super_counties": f"""WITH {SCORES}, {COUNTIES}, {WEIGHTS},
sm AS (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') AS cnty, 'd' || division AS super_cnty, CASE WHEN fips % 4 = 3 THEN 0.0 WHEN fips % 2 = 1 THEN 1.0 ELSE 0.5 END AS sw FROM county_dim),
r AS (SELECT s.*, {ENTITY.replace('group_id', 's.group_id')} AS u, uc.cnty, coalesce(gw.weight, 1) AS weight, sm.super_cnty, sm.sw FROM sf s JOIN uc ON uc.entity = {ENTITY.replace('group_id', 's.group_id')} LEFT JOIN gw ON gw.group_id = s.group_id JOIN sm ON sm.cnty = uc.cnty WHERE s.group_id NOT LIKE ':%' AND sw > 0),
a AS (SELECT group_id, u, feat, value, group_norm, weight, cnty FROM r WHERE sw = 1
  UNION ALL SELECT group_id, u, feat, sum(value * sw) OVER w / sum(sw) OVER w, sum(group_norm * sw) OVER w / sum(sw) OVER w, weight, super_cnty FROM r WHERE sw <> 1 WINDOW w AS (PARTITION BY yw, super_cnty, feat)),
k AS (SELECT ({WEEK}) || ':' || cnty AS key, * FROM a)
SELECT key, feat, round(sum(value), 6) AS sum_N_lexwords, round(sum(group_norm * weight) / sum(weight), 6) + 0.0 AS wavg_score, round(avg(group_norm), 6) + 0.0 AS avg_score, count(DISTINCT u) AS N_users FROM k WHERE key IS NOT NULL GROUP BY 1, 2""",
    "county_weeks": f"WITH {places()}{_PLACE_OUT}",
    "county_months": f"WITH {places('month')}{_PLACE_OUT}",
    "county_years": f"WITH {places('year')}{_PLACE_OUT}",
    "county_weeks_min_users": f"WITH {places()} SELECT key, feat, round(wavg_score, 6) AS wavg_score, N_users FROM pl WHERE N_users >= 3",
    "income_bins": f"WITH {INCOMES} SELECT user_id, {INCOME_BIN.format(x='income')} AS bin, round(income, 2) AS income FROM inc",
    "income_bin_shares": f"WITH {INCOMES}, k AS (SELECT cnty, yw, count(*) AS t FROM inc GROUP BY 1, 2), g AS (SELECT cnty, yw, t, unnest(range(0, 10)) AS bin FROM k), n AS (SELECT cnty, yw, {INCOME_BIN.format(x='income')} - 1 AS bin, count(*) AS n FROM inc GROUP BY 1, 2, 3) SELECT cnty, yw, CAST(bin AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share FROM g LEFT JOIN n USING (cnty, yw, bin)",
    "income_redistributed": f"""WITH {INCOMES}, p AS (SELECT {", ".join(f"quantile_cont(income, {c!r}) AS p{i + 1}" for i, c in enumerate(_CUM))}, max(income) AS p4, ceil(max(income)) + 1 AS top FROM inc),
r AS (SELECT user_id, round(CASE WHEN income < p1 THEN income / p1 * {TARGET_EDGES[1]} WHEN income < p2 THEN (income - p1) / (p2 - p1) * {TARGET_EDGES[2] - TARGET_EDGES[1]} + {TARGET_EDGES[1]}
  WHEN income < p3 THEN (income - p2) / (p3 - p2) * {TARGET_EDGES[3] - TARGET_EDGES[2]} + {TARGET_EDGES[2]} WHEN income < p4 THEN (income - p3) / (p4 - p3) * (top - {TARGET_EDGES[3]}) + {TARGET_EDGES[3]} ELSE top END, 3) AS income_redist FROM inc, p)
SELECT user_id, income_redist, {INCOME_BIN.format(x='income_redist')} AS bin FROM r""",
    "poststratified": poststratified("((n + 10 * pct / 100) / (t + 10))"),
    "poststratified_uninformed": poststratified("((n + 1) / (t + 10))"),
    "counties_filled": f"WITH {COUNTIES} SELECT w.entity, year_week, coalesce(uc.cnty, w.cnty) AS cnty FROM (SELECT DISTINCT split_part(user_id, ':', -1) AS entity, year_week, cnty FROM group_weight) w LEFT JOIN uc ON uc.entity = w.entity",
    "weekly_series": f"""WITH {places()}, e AS (SELECT min(Time) AS lo, max(Time) AS hi FROM pl WHERE feat IN ('ANX_SCORE', 'DEP_SCORE')),
s AS (SELECT Time AS yearweek, avg(wavg_score) FILTER (feat = 'ANX_SCORE') AS aa, stddev_pop(wavg_score) FILTER (feat = 'ANX_SCORE') AS sa, avg(wavg_score) FILTER (feat = 'DEP_SCORE') AS ad, stddev_pop(wavg_score) FILTER (feat = 'DEP_SCORE') AS sd,
  least(count(*) FILTER (feat = 'ANX_SCORE'), count(*) FILTER (feat = 'DEP_SCORE')) AS n FROM pl, e WHERE feat IN ('ANX_SCORE', 'DEP_SCORE') AND Time > lo AND Time < hi GROUP BY 1)
SELECT yearweek, {THURSDAY.format(w='yearweek')} AS date, n, round(aa, 6) AS "avg_ANX_SCORE", round(sa, 6) AS "std_ANX_SCORE", round(ad, 6) AS "avg_DEP_SCORE", round(sd, 6) AS "std_DEP_SCORE",
  round(sa / sqrt(nullif(n, 0)), 6) AS "se_ANX_SCORE", round(aa + sa / sqrt(nullif(n, 0)), 6) AS "up_ANX_SCORE", round(aa - sa / sqrt(nullif(n, 0)), 6) AS "down_ANX_SCORE",
  round(sd / sqrt(nullif(n, 0)), 6) AS "se_DEP_SCORE", round(ad + sd / sqrt(nullif(n, 0)), 6) AS "up_DEP_SCORE", round(ad - sd / sqrt(nullif(n, 0)), 6) AS "down_DEP_SCORE" FROM s""",
    "grain_means": f"""WITH {PANEL}, q AS (SELECT *, strftime({THURSDAY.format(w='yw')}, '%Y_%m') AS month, year({THURSDAY.format(w='yw')}) || '_Q' || quarter({THURSDAY.format(w='yw')}) AS quarter FROM panel)
SELECT yw, cnty, month, quarter, region_name, state_abbr,
  concat_ws('+', CASE WHEN grouping(yw) = 0 THEN 'yw' END, CASE WHEN grouping(cnty) = 0 THEN 'cnty' END, CASE WHEN grouping(month) = 0 THEN 'month' END, CASE WHEN grouping(quarter) = 0 THEN 'quarter' END, CASE WHEN grouping(region_name) = 0 THEN 'region_name' END, CASE WHEN grouping(state_abbr) = 0 THEN 'state_abbr' END) AS grain,
  count(dep) AS n, round(avg(dep), 6) AS mean FROM q GROUP BY GROUPING SETS ((yw), (cnty), (month), (quarter), (region_name), (region_name, quarter), (state_abbr), ())""",
    "means_and_errors": f"WITH {PANEL} SELECT division, yw, count(anx) AS n, round(avg(anx), 6) AS mean, round(stddev_samp(anx) / sqrt(nullif(count(anx), 0)), 6) AS sem FROM panel GROUP BY 1, 2",
    "year_over_year": f"""WITH {PANEL}, y AS (SELECT cnty, split_part(yw, '_', 1) AS y, split_part(yw, '_', 2) AS week_no, dep FROM panel),
p AS (SELECT a.cnty, a.week_no, a.dep AS later, b.dep AS earlier FROM y a JOIN y b ON a.cnty = b.cnty AND a.week_no = b.week_no WHERE a.y = '2020' AND b.y = '2019')
SELECT cnty, week_no, round(later, 6) AS later, round(earlier, 6) AS earlier, round(later - earlier + (SELECT avg(earlier) FROM p), 6) + 0.0 AS diff FROM p""",
    "centered_scores": f"WITH {PANEL} SELECT cnty, yw, round(avg(dep) OVER w, 6) AS dep_mean, round(dep - avg(dep) OVER w, 6) + 0.0 AS dep_centered, round(avg(anx) OVER w, 6) AS anx_mean, round(anx - avg(anx) OVER w, 6) + 0.0 AS anx_centered FROM panel WINDOW w AS (PARTITION BY cnty)",
    "full_coverage": f"""WITH {PANEL}, q AS (SELECT division, year({MONDAY.format(w='yw')}) || '_Q' || quarter({MONDAY.format(w='yw')}) AS quarter, avg(dep) AS dep FROM panel GROUP BY 1, 2)
SELECT division, quarter, round(dep, 6) AS dep FROM q WHERE division IN (SELECT division FROM q GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT quarter) FROM q))""",
    "busiest_county": f"WITH {COUNTIES}, n AS (SELECT state_abbr, uc.cnty, count(*) AS n_users FROM uc JOIN county_dim ON lpad(CAST(fips AS VARCHAR), 5, '0') = uc.cnty GROUP BY 1, 2) SELECT a.state_abbr, a.cnty, a.n_users FROM n a LEFT JOIN n b ON a.state_abbr = b.state_abbr AND a.n_users < b.n_users WHERE b.cnty IS NULL",
    "score_correlations": f"WITH {PANEL} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) > 0 THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL), 0) END, 6) AS r FROM panel" for a, b in (("dep", "anx"), ("dep", "ang"), ("dep", "n_users"), ("anx", "ang"), ("anx", "n_users"), ("ang", "n_users"))),
    "score_correlations_by_region": f"WITH {PANEL} SELECT region_name, 'dep' AS a, 'anx' AS b, count(*) FILTER (dep IS NOT NULL AND anx IS NOT NULL) AS n, round(covar_pop(dep, anx) / nullif(stddev_pop(dep) FILTER (anx IS NOT NULL) * stddev_pop(anx) FILTER (dep IS NOT NULL), 0), 6) AS r FROM panel GROUP BY 1",
    "melted_panel": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT cnty, yw, '{v}' AS variable, round({v}, 6) + 0.0 AS value FROM panel" for v in ("dep", "anx", "ang")),
    "counties_with_entries": f"WITH {PANEL} SELECT cnty, yw, n_users FROM panel QUALIFY count(*) OVER (PARTITION BY cnty) >= 10",
    "one_region": f"WITH {places()} SELECT key, feat, round(wavg_score, 6) AS wavg_score FROM pl WHERE Space IN (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') FROM county_dim WHERE region = 1)",
    "weeks_before": f"""WITH {places()}, e AS (SELECT min(Time) AS lo, max(Time) AS hi FROM pl WHERE feat IN ('ANX_SCORE', 'DEP_SCORE')),
s AS (SELECT Time AS yearweek, {THURSDAY.format(w='Time')} AS date, least(count(*) FILTER (feat = 'ANX_SCORE'), count(*) FILTER (feat = 'DEP_SCORE')) AS n FROM pl, e WHERE feat IN ('ANX_SCORE', 'DEP_SCORE') AND Time > lo AND Time < hi GROUP BY 1, 2)
SELECT yearweek, date, yearweek AS again, yearweek || ':' || strftime(date, '%Y-%m-%d') AS label, n FROM s WHERE date < DATE '2020-07-01'""",
    "series_with_events": f"""WITH {places()}, e AS (SELECT min(Time) AS lo, max(Time) AS hi FROM pl WHERE feat IN ('ANX_SCORE', 'DEP_SCORE')),
s AS (SELECT Time AS yearweek, {THURSDAY.format(w='Time')} AS date, least(count(*) FILTER (feat = 'ANX_SCORE'), count(*) FILTER (feat = 'DEP_SCORE')) AS n FROM pl, e WHERE feat IN ('ANX_SCORE', 'DEP_SCORE') AND Time > lo AND Time < hi GROUP BY 1, 2)
SELECT yearweek, date, concat_ws(', ', CASE WHEN DATE '2020-10-26' < date + 7 AND DATE '2020-12-27' >= date THEN 'autumn wave' END, CASE WHEN DATE '2020-03-16' < date + 7 AND DATE '2020-05-10' >= date THEN 'spring wave' END,
  CASE WHEN DATE '2020-11-03' < date + 7 AND DATE '2020-11-03' >= date THEN 'vote' END) AS events, n FROM s""",
    "some_divisions": f"WITH {places()} SELECT key, feat, round(wavg_score, 6) AS wavg_score FROM pl WHERE Space IN (SELECT lpad(CAST(fips AS VARCHAR), 5, '0') FROM county_dim WHERE division IN (1, 3))",
    "panel_summary": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS greatest FROM panel" for c in ("dep", "anx", "ang")),
    "distinct_places": f"WITH {PANEL} SELECT count(DISTINCT cnty) AS n_counties, count(DISTINCT yw) AS n_weeks FROM panel",
    "rolling_scores": f"WITH {PANEL} SELECT cnty, yw, round(avg(dep) OVER (PARTITION BY cnty ORDER BY yw ROWS 3 PRECEDING), 6) AS dep_rolling FROM panel",
    "anonymized_messages": f"WITH {MESSAGES} SELECT message_id, {anonymized('message')} AS message FROM m WHERE message IS NOT NULL",
    "duplicate_keys": f"WITH {MESSAGES}, a AS (SELECT * FROM m WHERE message IS NOT NULL), {keys_of('a')} SELECT message_id, dkey AS key FROM dk",
    "deduplicated_messages": f"WITH {MESSAGES}, a AS (SELECT * FROM m WHERE message IS NOT NULL AND user_id IS NOT NULL), {keys_of('a')} SELECT message_id, user_id FROM ({first_of_duplicates('user_id')})",
    "clean_messages": f"WITH {MESSAGES}, {cleaned('m', 'user_id')} SELECT message_id, user_id, {anonymized('message')} AS message FROM cl",
    "messages_to_scores": "WITH "
    + KEYED
    + ", "
    + cleaned("keyed", "group_id")
    + f", sp AS (SELECT * FROM cl WHERE message <> ''), {ngram_counts('sp', 'group_id', TOKENS, '1')}, "
    + scores_of("ft AS (SELECT group_id, feat, value, group_norm FROM cn)")
    + " SELECT group_id, category, round(value, 6) AS value, round(score + 1e-9, 6) + 0.0 AS score FROM sc",
    "pipeline_places": f"""WITH {MESSAGES}, u AS (SELECT *, trim({DECODED}) AS x FROM m WHERE message IS NOT NULL),
p AS (SELECT *, regexp_extract_all(lower(trim(regexp_replace(x, '(?:#|@)\\S+|https?://\\S+|www\\.\\S+', ' ', 'g'))), '[\\p{{L}}'']+') AS t FROM u WHERE x <> '' AND x <> 'NULL'),
lc AS (SELECT *, {", ".join(f"{c} AS {l}" for l, c in _STOP.items())} FROM p), lf AS (SELECT message_id, user_id, message, created_at, date2, date3 FROM lc WHERE en > greatest(de, 0) AND en >= greatest(es, fr, pt)),
{cleaned("lf", "user_id")}, an AS (SELECT * REPLACE ({anonymized("message")} AS message) FROM cl), k0{KEYED.split(", k0", 1)[1].replace("FROM m)", "FROM an)")}, sp AS (SELECT * FROM keyed WHERE message <> ''),
{ngram_counts("sp", "group_id", TOKENS, "1")}, av AS (SELECT group_id, feat, 2 * sqrt(value + 0.375) AS value FROM c WHERE feat NOT LIKE '@%'),
ft AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM av), {places().removeprefix(FEATURE_TABLE + ", ")}
SELECT key, feat, round(round(sum_N_lexwords, 10), 6) AS sum_N_lexwords, round(round(wavg_score, 10), 6) AS wavg_score, N_users FROM pl WHERE N_users >= 1 AND feat <> '_int' AND Space <> '' AND Time <> ''""",
    "stream_ngrams": f"WITH {MESSAGES.replace('SELECT DISTINCT', 'SELECT')}, k0 AS (SELECT *, {_TS} AS ts FROM m), w AS (SELECT strftime(ts, '%G_%V') || ':' || user_id AS group_id, unnest({TOKENS}) AS feat FROM k0 WHERE ts IS NOT NULL AND user_id IS NOT NULL AND message IS NOT NULL) SELECT group_id, lower(feat) AS feat, count(*) AS value FROM w GROUP BY 1, 2",
    "any_language_filter": f"""WITH {MESSAGES}, u AS (SELECT message_id, trim({DECODED}) AS x FROM m WHERE message IS NOT NULL),
p AS (SELECT message_id, regexp_extract_all(lower(trim(regexp_replace(x, '(?:#|@)\\S+|https?://\\S+|www\\.\\S+', ' ', 'g'))), '[\\p{{L}}'']+') AS t FROM u WHERE x <> '' AND x <> 'NULL'),
n AS (SELECT message_id, {", ".join(f"{c} AS {l}" for l, c in _STOP.items())} FROM p), b AS (SELECT *, greatest({", ".join(_STOP)}) AS top, {" + ".join(_STOP)} AS every FROM n)
SELECT message_id, CASE {" ".join(f"WHEN {l} = top THEN '{l}'" for l in sorted(_STOP))} END AS lang, round(top / every, 8) AS confidence FROM b WHERE every > 0 AND round(top / every, 8) > 0.8""",
    "complete_rows": "SELECT * FROM user_county WHERE user_id IS NOT NULL AND cnty IS NOT NULL",
    "dependency_labels": "SELECT token, count(*) AS n FROM (SELECT state_abbr AS token FROM county_dim UNION ALL SELECT 'in' FROM county_dim) GROUP BY 1",
    "posts_by_first_word": f"WITH {MESSAGES} SELECT regexp_split_to_array(created_at, '[ \\t\\n\\x0B\\f\\r]+')[1] AS word, count(*) AS n FROM m WHERE created_at IS NOT NULL GROUP BY 1",
    "cleaned_numbers": f"WITH {MESSAGES} SELECT DISTINCT message_id, coalesce(TRY_CAST(regexp_replace(user_id, '^[\\s\"]+|[\\s\"]+$', '', 'g') AS DOUBLE), 0.0) AS number FROM m",
    "first_messages_of_users": f"WITH {MESSAGES}, u AS (SELECT DISTINCT user_id, message_id FROM m WHERE user_id IS NOT NULL AND message_id IS NOT NULL) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY message_id) <= 2",
    "counties_in_order": "SELECT fips, state_abbr, CAST(row_number() OVER (PARTITION BY state_abbr ORDER BY fips) AS INT) AS place FROM county_dim",
    "incomes_filled": "WITH i AS (SELECT DISTINCT user_id FROM user_county WHERE user_id IS NOT NULL) SELECT CAST(user_id AS VARCHAR) AS entity, "
    + ", ".join(f"CAST(CASE WHEN user_id % 3 = 0 AND user_id % {i + 2} <> 0 THEN user_id * {i + 1} ELSE user_id % {i + 5} END AS DOUBLE) AS inc_{i}" for i in range(6))
    + " FROM i",
    "reliability_d": effects("'DEP_SCORE'", MONTH_KEY, "group_norm"),
    "reliability_h": effects("'DEP_SCORE'", MONTH_KEY, "CAST(group_norm > 2.5 AS DOUBLE)", measure="h"),
    "reliability_single_split": effects("'ANX_SCORE'", "cnty", "group_norm", name="cnty", splits=1),
    "reliability_sweep": effects("'DEP_SCORE'", "cnty", "group_norm", name="cnty", thresholds=(3, 10, 30, 100), last="SELECT threshold, count(*) AS n_groups, round(avg(effect), 6) AS effect, round(avg(CAST(reliable AS DOUBLE)), 6) AS share_reliable FROM ef WHERE effect IS NOT NULL GROUP BY 1"),
    "regression_by_region": coefficients("SELECT region_name AS k, dep AS y, anx AS x FROM panel", "region_name"),
    "regressions": coefficients(" UNION ALL ".join(f"SELECT '{y} ~ {x}' AS k, {y} AS y, {x} AS x FROM panel" for a, b in (("dep", "anx"), ("dep", "ang"), ("anx", "ang"), ("dep", "n_users")) for y, x in ((a, b), (b, a))), "formula"),
    "poststratified_age": poststratified_by("age", W.AGE.edges),
    "poststratified_gender": poststratified_by("gender", W.GENDER.edges),
    "poststratified_education": poststratified_by("education", W.EDUCATION.edges),
    "intraclass": f"""WITH {PLACED}, d AS (SELECT cnty, group_norm AS x FROM placed WHERE feat = 'DEP_SCORE'),
e AS (SELECT cnty, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM d GROUP BY 1), th AS (SELECT unnest([0, 3, 10]) AS threshold),
k AS (SELECT threshold, e.* FROM e, th WHERE n >= threshold), s AS (SELECT threshold, count(*) AS g, sum(n) AS o, sum(ss) AS ssw, sum(n * m) / sum(n) AS mean, sum(n * n) AS nn FROM k GROUP BY 1),
b AS (SELECT k.threshold, sum(n * pow(m - mean, 2)) AS ssb FROM k JOIN s ON s.threshold = k.threshold GROUP BY 1),
t AS (SELECT s.*, ssb / (g - 1) AS msb, ssw / (o - g) AS msw, (o - nn / o) / (g - 1) AS n0 FROM s JOIN b ON b.threshold = s.threshold),
i AS (SELECT *, (msb - msw) / (msb + (g - 1) * msw) AS r, (msb - msw) / (msb + (n0 - 1) * msw) AS std FROM t),
two AS (SELECT k.threshold, avg(n * r / (1 + (n - 1) * r)) AS m2, stddev_pop(n * r / (1 + (n - 1) * r)) AS s2 FROM k JOIN i ON i.threshold = k.threshold GROUP BY 1)
SELECT i.threshold, g AS n_groups, o AS n_obs, round(o / g, 6) AS avg_n, round(msb, 6) AS ms_between, round(msw, 6) AS ms_within, round(msb / msw, 6) AS f, round(r, 6) AS icc1_ref, round(std, 6) AS icc1, round(m2, 6) AS icc2_mean, round(s2, 6) AS icc2_std FROM i JOIN two ON two.threshold = i.threshold""",
    "regression": f"""WITH {PANEL}, s AS (SELECT regr_count(dep, anx) AS n, regr_slope(dep, anx) AS b, regr_intercept(dep, anx) AS a, regr_r2(dep, anx) AS r2, regr_sxx(dep, anx) AS sxx, regr_syy(dep, anx) AS syy, regr_sxy(dep, anx) AS sxy, regr_avgx(dep, anx) AS mx FROM panel),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS mse FROM s)
SELECT n, round(b, 6) AS slope, round(a, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(mse / sxx), 6) AS slope_se, round(sqrt(mse * (1 / n + mx * mx / sxx)), 6) AS intercept_se, round(b / sqrt(mse / sxx), 4) AS slope_t FROM e""",
    "written_and_read": f"WITH {SCORES} SELECT category, count(*) AS n, round(sum(score), 6) AS total FROM sc GROUP BY 1 UNION ALL SELECT category || '_matched', count(*), round(sum(score), 6) FROM sc WHERE value > 0 GROUP BY 1",
}


def settled(sql: str) -> str:
    """``round(x, 6)`` as ``round(round(x, 10), 6)``: sums that differ in their last bit then round alike."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = settled(sql[i + 6 : j - 1])
        out += sql[at:i] + (f"round(round({inner[:-3]}, 10), 6)" if inner.endswith(", 6") else f"round({inner})")
        at = j
    return out + sql[at:]


ORACLES = {name: settled(sql) for name, sql in ORACLES.items()}
