"""Queries over creative delivery, each with its SQL counterpart."""

from leakscope.functions import constants as K
from leakscope.operators import creative_performance as P
from leakscope.operators import creative_profile as R
from leakscope.operators import creative_quality as Q
from leakscope.operators import creative_sizes as Z
from leakscope.operators import creative_utm as U
from leakscope.operators.creative_alert import creative_alert_rows
from leakscope.plans import facts
from leakscope.plans import oracle as O

C = O.CTES

C["creative_parts"] = """
SELECT l.*, p.p_partkey, s.s_nationkey, sn.n_name AS supplier_nation,
  CASE WHEN l_suppkey % 20 = 3 THEN 1 WHEN l_suppkey % 20 = 7 AND l_linenumber <> 1 THEN 1
    ELSE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) END AS cb,
  CAST(l_quantity AS BIGINT) * 1000 AS impr, CAST(l_shipdate AS DATE) AS day
FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
"""
C["creative_feed"] = """
SELECT day AS date, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'BU-' || CAST(s_nationkey % 5 AS VARCHAR) END
    AS business_unit, supplier_nation AS client,
  CASE l_suppkey % 7 WHEN 0 THEN 'Display' WHEN 1 THEN 'Social Mirror' WHEN 2 THEN 'Video'
    WHEN 3 THEN 'CTV' WHEN 4 THEN 'Native Display' WHEN 5 THEN 'Online Audio'
    ELSE 'Leaked ' || CAST(l_suppkey AS VARCHAR) END AS product,
  l_returnflag AS strategy_type, l_returnflag || '/' || l_linestatus AS strategy_name,
  'Pool ' || CAST(l_suppkey AS VARCHAR) AS campaign, CAST(l_suppkey AS VARCHAR) AS campaign_id,
  'P' || CAST(l_suppkey AS VARCHAR) AS campaign_pool_id,
  CASE cb WHEN 6 THEN '' WHEN 10 THEN '9' ELSE CAST(cb AS VARCHAR) END AS creative_id,
  CASE cb WHEN 24 THEN NULL WHEN 25 THEN 'untitled' ELSE 'Brand' || CAST(cb AS VARCHAR) || ' ' ||
    CASE cb % 6 WHEN 0 THEN '300x250' WHEN 1 THEN '1080x1080' WHEN 2 THEN '728x90'
      WHEN 3 THEN 'v2.mp4' WHEN 4 THEN 'hero.jpg' ELSE 'spring' END END AS creative,
  CASE cb % 5 WHEN 0 THEN '320 x 50' WHEN 1 THEN '' END AS creative_size,
  CASE cb % 4 WHEN 0 THEN 'video' WHEN 1 THEN ' banner ' WHEN 2 THEN '-' ELSE 'native' END
    AS creative_type,
  CASE cb % 7 WHEN 0 THEN NULL
    WHEN 1 THEN 'https://shop' || CAST(cb AS VARCHAR) || '.example.com/?utm_source=a&utm_medium=b&utm_campaign=c'
    WHEN 2 THEN 'https://shop' || CAST(cb AS VARCHAR) || '.example.com/?utm_source=a'
    WHEN 3 THEN 'https://shop' || CAST(cb AS VARCHAR) || '.example.com/?gclid=x'
    WHEN 5 THEN 'https://shop' || CAST(cb AS VARCHAR) || '.example.com/p' || CAST(l_suppkey % 2 AS VARCHAR)
    ELSE 'https://shop' || CAST(cb AS VARCHAR) || '.example.com/' END AS click_url,
  CASE WHEN cb % 9 = 0 THEN NULL
    ELSE 'https://img.example.com/' || CAST(cb AS VARCHAR) || '.png' END AS preview_url,
  impr AS impressions,
  CASE WHEN cb = 12 AND l_quantity = 1 THEN impr + 1 ELSE impr * (CASE WHEN cb = 2 THEN 0
    WHEN cb = 5 THEN 30000 WHEN cb = 8 AND day > DATE '1998-06-04' THEN 500 ELSE 3000 END)
    // 1000000 END AS clicks,
  CAST(CASE WHEN l_returnflag = 'R' AND cb <> 11 THEN 1 ELSE 0 END AS BIGINT) AS conversions,
  CAST(CASE WHEN cb = 13 THEN 0 ELSE l_extendedprice END AS DECIMAL(18, 2)) AS spend,
  impr * 70 // 100 AS q25, impr * 60 // 100 AS q50, impr * 50 // 100 AS q75,
  impr * (CASE WHEN cb % 2 = 0 THEN 40 ELSE 60 END) // 100 AS q100
FROM creative_parts
"""
BLANK = O.texts(K.BLANK_TEXTS)
_PLACEHOLDER = (f"lower(trim(creative)) IN {O.texts(K.PLACEHOLDER_NAMES)} OR "
                "(regexp_matches(trim(creative), "
                "'(?i)^(copy of|untitled|new creative|creative\\s*\\d*)\\b') "
                "AND length(trim(creative)) <= 24) OR length(trim(creative)) <= 2")
SIZE = "nullif(regexp_extract(coalesce(creative, ''), '[0-9]{2,4}x[0-9]{2,4}'), '')"
VIDEO, STILL = O.texts(K.VIDEO_PRODUCTS), O.texts(K.STILL_PRODUCTS)
# Creative ids of named rows that have several names.
C["conflict_ids"] = f"""
SELECT creative_id FROM creative_feed
WHERE NOT (coalesce(trim(creative), '') = '' OR {_PLACEHOLDER})
  AND lower(trim(creative_id)) NOT IN {BLANK}
GROUP BY creative_id HAVING count(DISTINCT creative) > 1
"""
C["checked"] = f"""
SELECT *, issue IS NOT NULL AS blank_creative,
  issue IS NULL AND social AND banner AS sm_display_size,
  issue IS NULL AND social AND sizes <> '' AND NOT banner AS sm_social_size,
  issue IS NULL AND ((lower(product) IN {VIDEO} AND regexp_matches(creative, '(?i)\\.(jpe?g|png|gif|webp|bmp)\\b'))
    OR (lower(product) IN {STILL} AND regexp_matches(creative, '(?i)\\.(mp4|mov|m4v|webm|avi)\\b')))
    AS format_mismatch,
  issue IS NULL AND coalesce(lower(trim(preview_url)), '') IN {BLANK} AS missing_preview,
  issue IS NULL AND coalesce(lower(trim(click_url)), '') IN {BLANK} AS missing_click_url,
  issue IS NULL AND coalesce(lower(trim(click_url)), '') NOT IN {BLANK}
    AND NOT contains(lower(click_url), 'utm_') AS no_utm,
  issue IS NULL AND coalesce(lower(trim(creative_id)), '') IN {BLANK} AS missing_creative_id,
  issue IS NULL AND creative_id IN (SELECT creative_id FROM conflict_ids) AS id_name_conflict,
  lower(trim(product)) NOT IN {O.texts(K.CREATIVE_PRODUCTS)} AS unmapped_product,
  coalesce(trim(business_unit), '') IN ('', 'nan', 'None') AS missing_bu,
  clicks > impressions OR impressions < 0 OR clicks < 0 OR spend < 0 AS impossible_metrics,
  impressions > 0 AND spend <= 0 AS delivery_no_spend
FROM (SELECT *, coalesce({SIZE}, '') AS sizes, lower(product) = 'social mirror' AS social,
    coalesce({SIZE}, '') IN {O.texts(K.BANNER_SIZES)} AS banner,
    CASE WHEN coalesce(trim(creative), '') = '' THEN 'empty'
      WHEN {_PLACEHOLDER} THEN 'placeholder' END AS issue FROM creative_feed)
"""
C["named_rows"] = "SELECT * FROM checked WHERE issue IS NULL"
C["check_counts"] = " UNION ALL ".join(
    f"SELECT '{k}' AS key, '{label.replace(chr(39), chr(39) * 2)}' AS label, "
    f"'{severity}' AS severity, count(*) AS rows, {O.sums('impressions', 'spend')}, "
    f"{'count(DISTINCT creative)' if k in Q.GROUPED_CHECKS else 'CAST(NULL AS BIGINT)'} "
    f"AS creatives FROM checked WHERE {k}"
    for k, (label, severity) in K.CREATIVE_CHECKS.items()
)
_CAMPAIGN = ", ".join(Q.CAMPAIGN_KEYS)
C["blank_camps"] = f"""
SELECT {_CAMPAIGN}, issue,
  CASE WHEN blank_rows >= total_rows THEN 'every row' ELSE CAST(blank_rows AS VARCHAR) || ' of '
    || CAST(total_rows AS VARCHAR) || ' rows' END AS coverage,
  blank_rows, impressions, clicks, spend, first_seen, last_seen
FROM (SELECT {_CAMPAIGN}, string_agg(DISTINCT issue, ', ' ORDER BY issue) AS issue,
    count(issue) AS blank_rows, count(*) AS total_rows,
    {O.n('impressions', 'blank_creative')} AS impressions,
    {O.n('clicks', 'blank_creative')} AS clicks, {O.money('spend', 'blank_creative')} AS spend,
    strftime(min(date) FILTER (WHERE blank_creative), '%Y-%m-%d') AS first_seen,
    strftime(max(date) FILTER (WHERE blank_creative), '%Y-%m-%d') AS last_seen
  FROM checked GROUP BY {_CAMPAIGN})
WHERE blank_rows > 0
"""
_ROSTER = ", ".join(P.ROSTER_KEYS)
C["roster"] = f"""
SELECT *, {O.CTR} AS ctr, {O.cpm()} AS cpm, {O.ratio('spend', 'conversions', 'NULL')} AS cost_per_conv
FROM (SELECT {_ROSTER}, {O.sums('impressions', 'clicks', 'spend', 'conversions')},
    count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS first_seen,
    strftime(max(date), '%Y-%m-%d') AS last_seen, count(DISTINCT date) AS days
  FROM named_rows GROUP BY {_ROSTER})
"""
C["rated"] = f"""
SELECT r.*, product_ctr, {O.ratio('ctr', 'product_ctr')} AS x_over_norm
FROM roster r JOIN (SELECT product, {O.ratio('sum(clicks)', 'sum(impressions)')} AS product_ctr
  FROM named_rows GROUP BY product) USING (product)
"""
CLICKABLE = f"lower(trim(product)) NOT IN {O.texts(K.NO_CLICK_CREATIVE_PRODUCTS)}"
C["winners"] = f"""
SELECT *, CASE WHEN x_over_norm >= 10 THEN 'verify — implausibly high, check for invalid traffic'
  ELSE 'outperformer — worth scaling / reusing' END AS read
FROM rated WHERE {CLICKABLE} AND impressions >= 10000 AND x_over_norm >= 3 AND clicks > 0
"""
C["laggards"] = f"""
SELECT * FROM rated
WHERE {CLICKABLE} AND impressions >= 10000 AND x_over_norm <= CAST(1 AS DOUBLE) / 3
"""
C["quiet"] = f"SELECT * FROM roster WHERE {CLICKABLE} AND clicks = 0 AND impressions >= 5000"
C["idle"] = "SELECT * FROM roster WHERE conversions = 0 AND spend >= 50"
C["halves"] = f"""
SELECT client, product, campaign_id, creative, {O.money('spend')} AS spend,
  {O.n('impressions', 'early')} AS ia, {O.n('impressions', 'NOT early')} AS ib,
  {O.n('clicks', 'early')} AS ca, {O.n('clicks', 'NOT early')} AS cb
FROM (SELECT *, CAST(date AS TIMESTAMP) <= (SELECT CAST(min(date) AS TIMESTAMP)
    + (CAST(max(date) AS TIMESTAMP) - CAST(min(date) AS TIMESTAMP)) / 2 FROM named_rows) AS early
  FROM named_rows) GROUP BY 1, 2, 3, 4
"""
C["tired"] = f"""
SELECT client, product, campaign_id, creative, ia + ib AS impressions, spend,
  a AS ctr_early, b AS ctr_late, 1 - b / a AS drop
FROM (SELECT *, CAST(ca AS DOUBLE) / CAST(ia AS DOUBLE) AS a, CAST(cb AS DOUBLE) / CAST(ib AS DOUBLE) AS b
  FROM halves WHERE ia >= 5000 AND ib >= 5000)
WHERE a > 0 AND 1 - b / a >= CAST(0.4 AS DOUBLE) AND {CLICKABLE}
"""
C["camps"] = f"""
SELECT client, product, campaign, campaign_id, count(DISTINCT creative) AS creatives,
  {O.sums('impressions', 'clicks', 'spend')} FROM named_rows GROUP BY 1, 2, 3, 4
"""
C["dominants"] = """
SELECT r.*, c.impressions AS campaign_impressions,
  CAST(r.impressions AS DOUBLE) / CAST(c.impressions AS DOUBLE) AS share
FROM roster r JOIN camps c USING (client, product, campaign, campaign_id)
WHERE c.creatives >= 3 AND c.impressions >= 10000
  AND CAST(r.impressions AS DOUBLE) / CAST(c.impressions AS DOUBLE) >= CAST(0.8 AS DOUBLE)
"""
C["dupes"] = f"""
SELECT creative, count(DISTINCT client) AS clients, count(DISTINCT campaign_id) AS campaigns,
  {O.sums('impressions', 'spend')} FROM named_rows GROUP BY creative
HAVING count(DISTINCT client) > 1
"""


def _keys_sql(keys):
    parts = ", ".join(f"CASE WHEN contains(lower(trim(url)), '{k}=') THEN '{k}' END" for k in keys)
    return f"concat_ws(', ', {parts})"


def _tagged(src):
    count = " + ".join(f"CAST(contains(lower(trim(url)), '{k}=') AS INTEGER)" for k in K.UTM_KEYS)
    core = " AND ".join(f"contains(lower(trim(url)), '{k}=')" for k in K.UTM_CORE)
    return f"""
SELECT *, {_keys_sql(K.UTM_KEYS)} AS utm_params, {count} AS utm_count,
  {_keys_sql(K.OTHER_TRACKING_KEYS)} AS other_tracking,
  CASE WHEN url = '' THEN 'no clickthrough URL' WHEN ({count}) = 0 THEN 'no UTM codes'
    WHEN {core} THEN 'fully tagged' ELSE 'partially tagged' END AS status
FROM ({src})"""


_PLACED = ", ".join(U.PLACEMENT_KEYS)
C["urls"] = f"""
SELECT {_PLACED}, CASE WHEN coalesce(lower(trim(click_url)), '') IN {BLANK} THEN '' ELSE click_url END
    AS url, {O.sums('impressions', 'clicks')}, sum(spend) AS spend
FROM named_rows GROUP BY ALL
"""
C["url_placements"] = f"""
SELECT {_PLACED}, coalesce(max(url) FILTER (WHERE rn = 1 AND url <> ''), '') AS url,
  count(*) FILTER (WHERE url <> '') AS urls_seen, {O.sums('impressions', 'clicks', 'spend')},
  {O.ratio('sum(clicks)', 'sum(impressions)')} AS ctr
FROM (SELECT *, row_number() OVER (PARTITION BY {_PLACED}
    ORDER BY url = '', impressions DESC, url DESC) AS rn FROM urls)
GROUP BY {_PLACED}
"""
C["tagged_placements"] = _tagged("SELECT * FROM url_placements")
C["url_creatives"] = f"""
SELECT creative_key, max(creative) FILTER (WHERE rn = 1) AS creative,
  max(client) FILTER (WHERE rn = 1) AS client, max(product) FILTER (WHERE rn = 1) AS product,
  max(url) FILTER (WHERE rn = 1) AS url, count(DISTINCT campaign_id) AS campaigns,
  count(DISTINCT nullif(url, '')) AS distinct_urls, {O.sums('impressions', 'clicks', 'spend')},
  {O.ratio('sum(clicks)', 'sum(impressions)')} AS ctr
FROM (SELECT *, row_number() OVER (PARTITION BY creative_key ORDER BY impressions DESC,
    client DESC, product DESC, campaign_id DESC, creative_id DESC, creative DESC) AS rn
  FROM (SELECT *, CASE WHEN creative_id = '' THEN creative ELSE creative_id END AS creative_key
    FROM url_placements))
GROUP BY creative_key
"""
C["tagged_creatives"] = _tagged("SELECT * FROM url_creatives")
_SLICES = {
    "tagged": "utm_count > 0",
    "fully_tagged": "status = 'fully tagged'",
    "partially_tagged": "status = 'partially tagged'",
    "untagged": "utm_count = 0 AND url <> ''",
    "no_url": "url = ''",
    "other_tracking_only": "utm_count = 0 AND other_tracking <> ''",
    "multi_url": "distinct_urls > 1",
}
C["utm_slices"] = " UNION ALL ".join(
    f"SELECT '{k}' AS slice, count(*) FILTER (WHERE {w}) AS creatives, "
    f"{O.n('impressions', w)} AS impressions, round({O.money('spend', w)}, 2) AS spend, "
    f"{O.ratio(O.n('impressions', w), 'sum(impressions)')} AS impr_pct FROM tagged_creatives"
    for k, w in _SLICES.items()
)
C["sized_rows"] = f"""
SELECT *, coalesce(CASE WHEN coalesce(lower(trim(creative_size)), '') IN {BLANK} THEN {SIZE}
    ELSE replace(lower(trim(creative_size)), ' ', '') END, '(not specified)') AS size,
  CASE WHEN coalesce(lower(trim(creative_type)), '') IN {BLANK} THEN '(not specified)'
    ELSE trim(creative_type) END AS type,
  coalesce(lower(trim(creative_size)), '') IN {BLANK} AS from_name FROM named_rows
"""


def _rollup_sql(keys):
    cols = ", ".join(keys)
    return f"""
SELECT *, {O.CTR} AS ctr, {O.cpm()} AS cpm, {O.ratio('conversions', 'impressions')} AS conv_rate,
  {O.ratio('q100', 'impressions')} AS vcr, {O.ratio('q25', 'impressions')} AS q25_rate,
  CAST(impressions AS DOUBLE) / CAST((SELECT sum(impressions) FROM sized_rows) AS DOUBLE)
    AS pct_of_impr
FROM (SELECT {cols}, count(DISTINCT creative) AS creatives,
    count(DISTINCT campaign_id) AS campaigns,
    {O.sums('impressions', 'clicks', 'conversions', 'spend', 'q25', 'q50', 'q75', 'q100')}
  FROM sized_rows GROUP BY {cols})"""


C["completion"] = f"""
SELECT *, {O.ratio('q100', 'impressions')} AS vcr, {O.ratio('q25', 'impressions')} AS q25_rate,
  {O.ratio('q50', 'impressions')} AS q50_rate, {O.ratio('q75', 'impressions')} AS q75_rate,
  1 - CAST(q100 AS DOUBLE) / CAST(q25 AS DOUBLE) AS dropoff
FROM (SELECT {_PLACED}, {O.sums('impressions', 'spend', 'q25', 'q50', 'q75', 'q100')}
  FROM named_rows GROUP BY {_PLACED}) WHERE q25 > 0
"""
C["size_counts"] = """
SELECT count(DISTINCT size) AS sizes, count(DISTINCT type) AS types,
  count(*) FILTER (WHERE from_name) AS size_from_name,
  (SELECT count(*) FROM completion) AS completion_creatives,
  (SELECT count(*) FROM completion WHERE impressions >= 5000 AND vcr < 0.5) AS low_vcr
FROM sized_rows
"""
C["perf_counts"] = """
SELECT count(DISTINCT creative) AS creatives, count(*) AS creative_campaign_pairs,
  (SELECT count(*) FROM winners) AS winners, (SELECT count(*) FROM laggards) AS laggards,
  (SELECT count(*) FROM quiet) AS no_clicks,
  (SELECT round(coalesce(sum(spend), 0), 2) FROM quiet) AS no_clicks_spend,
  (SELECT count(*) FROM idle) AS no_conv,
  (SELECT round(coalesce(sum(spend), 0), 2) FROM idle) AS no_conv_spend,
  (SELECT count(*) FROM tired) AS fatigue,
  (SELECT count(*) FROM camps WHERE creatives = 1 AND impressions >= 10000) AS single_creative,
  (SELECT count(*) FROM dominants) AS dominant, (SELECT count(*) FROM dupes) AS dupe_names
FROM roster
"""
_PERF = ", ".join(f"(SELECT {c} FROM perf_counts) AS perf_{c}" for c in R.COUNTS)
_SIZES = ", ".join(f"(SELECT {c} FROM size_counts) AS st_{c}" for c in R.SIZE_COUNTS)


def _slice(name, c="creatives"):
    return f"(SELECT {c} FROM utm_slices WHERE slice = '{name}')"


C["feed_summary"] = f"""
SELECT count(*) AS rows, {O.n('impressions')} AS impressions, {O.money('spend')} AS spend,
  count(DISTINCT creative) FILTER (WHERE issue IS NULL) AS creatives,
  strftime(min(date), '%Y-%m-%d') AS window_start, strftime(max(date), '%Y-%m-%d') AS window_end,
  count(issue) AS blank_rows, count(*) FILTER (WHERE issue = 'empty') AS blank_empty,
  count(*) FILTER (WHERE issue = 'placeholder') AS blank_placeholder,
  {O.n('impressions', 'blank_creative')} AS blank_impressions,
  {O.money('spend', 'blank_creative')} AS blank_spend,
  {O.ratio(O.n('impressions', 'blank_creative'), 'sum(impressions)')} AS blank_impr_pct,
  {O.ratio(O.money('spend', 'blank_creative'), 'sum(spend)')} AS blank_spend_pct,
  true AS has_creative_id, true AS has_click_url, true AS has_preview_url,
  true AS has_quartiles, true AS has_creative_size, true AS has_creative_type,
  (SELECT count(*) FROM blank_camps) AS blank_campaigns,
  (SELECT count(*) FROM blank_camps WHERE impressions >= 1) AS blank_campaigns_delivering,
  (SELECT count(DISTINCT client) FROM blank_camps) AS blank_clients,
  (SELECT count(DISTINCT creative) FROM checked WHERE missing_preview) AS missing_preview_creatives,
  (SELECT {O.n('rows')} FROM check_counts) AS issues,
  (SELECT {O.n('rows', "severity = 'critical'")} FROM check_counts) AS critical_issues,
  CASE WHEN (SELECT count(*) FROM blank_camps) > 0
    OR (SELECT sum(rows) FROM check_counts WHERE severity = 'critical') > 0 THEN 'fail'
    WHEN (SELECT sum(rows) FROM check_counts WHERE severity = 'warn') > 0 THEN 'warn'
    ELSE 'clean' END AS status,
  (SELECT count(DISTINCT creative) FROM checked WHERE sm_display_size)
    AS sm_display_size_creatives, {_PERF}, {_SIZES},
  (SELECT count(*) FROM tagged_creatives) AS utm_creatives, {_slice('tagged')} AS utm_tagged,
  CAST({_slice('tagged')} AS DOUBLE) / (SELECT count(*) FROM tagged_creatives) AS utm_tagged_pct,
  {_slice('fully_tagged')} AS utm_fully_tagged, {_slice('partially_tagged')} AS utm_partial,
  {_slice('untagged')} AS utm_untagged, {_slice('no_url')} AS utm_no_url,
  {_slice('tagged', 'impr_pct')} AS utm_tagged_impr_pct
FROM checked
"""
C["grouped_flags"] = " UNION ALL ".join(
    f"SELECT '{k}' AS key, {', '.join(Q.CREATIVE_KEYS)}, sizes, count(*) AS days, "
    f"{O.sums('impressions', 'clicks', 'spend')} FROM checked WHERE {k} GROUP BY ALL"
    for k in Q.GROUPED_CHECKS
)
_FINDINGS = [
    ("(SELECT count(DISTINCT creative) FROM grouped_flags WHERE key = 'sm_display_size')",
     "CAST(n AS VARCHAR) || ' Social Mirror creative(s) named with a display banner size (' || "
     "format('{:,}', (SELECT CAST(coalesce(sum(impressions), 0) AS BIGINT) FROM grouped_flags "
     "WHERE key = 'sm_display_size')) || ' impressions) — likely a display asset on a social line'"),
    ("(SELECT no_clicks FROM perf_counts)",
     "CAST(n AS VARCHAR) || ' creative(s) delivering with zero clicks'"),
    ("(SELECT fatigue FROM perf_counts)",
     "CAST(n AS VARCHAR) || ' creative(s) with CTR down sharply across the window'"),
    ("(SELECT single_creative FROM perf_counts)",
     "CAST(n AS VARCHAR) || ' campaign(s) delivering on a single creative — no rotation'"),
    ("(SELECT laggards FROM perf_counts)",
     "CAST(n AS VARCHAR) || ' creative(s) at or below ⅓ of their product''s CTR norm'"),
    ("(SELECT missing_preview_creatives FROM feed_summary)",
     "CAST(n AS VARCHAR) || ' creative(s) with no preview image URL — can''t be visually QA''d'"),
    ("(SELECT count(*) FROM tagged_creatives)",
     "(SELECT CAST(t AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' creatives (' || "
     "CAST(CAST(floor(t * CAST(100 AS DOUBLE) / n + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || "
     "'%) are running UTM codes — ' || CAST(u AS VARCHAR) || ' carry none, ' || "
     "CAST(p AS VARCHAR) || ' are partially tagged' FROM (SELECT "
     "count(*) FILTER (WHERE utm_count > 0) AS t, "
     "count(*) FILTER (WHERE utm_count = 0 AND url <> '') AS u, "
     "count(*) FILTER (WHERE status = 'partially tagged') AS p FROM tagged_creatives))"),
    ("(SELECT low_vcr FROM size_counts)",
     "CAST(n AS VARCHAR) || ' video creative(s) below the completion-rate floor'"),
]
C["alert_rows"] = """
SELECT 'headline' AS section, 0 AS position, blank_rows AS count,
  CASE WHEN blank_campaigns_delivering > 0 THEN '⚠ Creative QA: '
      || CAST(blank_campaigns_delivering AS VARCHAR)
      || ' campaign(s) delivering with NO creative name'
    WHEN blank_rows > 0 THEN 'Creative QA: ' || CAST(blank_rows AS VARCHAR)
      || ' blank creative row(s)'
    ELSE '⚠ Creative QA: ' || CAST(critical_issues AS VARCHAR) || ' trafficking issue(s)' END
    || ' — ' || window_start || ' → ' || window_end AS text
FROM feed_summary WHERE blank_rows > 0 OR critical_issues > 0
UNION ALL
""" + "UNION ALL\n".join(
    f"SELECT 'finding', {i}, n, {text} FROM (SELECT {count} AS n) WHERE n > 0\n"
    for i, (count, text) in enumerate(_FINDINGS, 1)
) + """
UNION ALL
SELECT 'campaign', CAST(NULL AS INTEGER), impressions,
  concat_ws(' | ', client, product, campaign, campaign_id, coverage) FROM blank_camps
"""

QUERIES: dict = {}


def add(name, make, sql):
    """Register an operator that takes the creative fact."""
    QUERIES[name] = (lambda spark, sf: make(facts.creative(spark, sf)), O.statement(sql))


add("creative_checks", Q.creative_checks, "SELECT * FROM check_counts")
_ROW = ("date, business_unit, client, product, campaign, campaign_id, creative_id, creative, "
        "sizes, impressions, clicks, CAST(spend AS DOUBLE) AS spend")
for _key in K.CREATIVE_CHECKS:
    add(f"creative_check_rows_{_key}",
        lambda d, k=_key: Q.creative_check_rows(d, k).selectExpr(*[
            c.strip() for c in _ROW.split(",")]),
        f"SELECT {_ROW} FROM checked WHERE {_key}")
add("blank_campaigns", Q.blank_campaigns, "SELECT * FROM blank_camps")
add("blank_campaigns_delivering", lambda d: Q.blank_campaigns_delivering(d, 1000000),
    "SELECT * FROM blank_camps WHERE impressions >= 1000000")
add("blank_rows", Q.blank_rows, """
SELECT date, business_unit, client, product, strategy_type, strategy_name, campaign, campaign_id,
  campaign_pool_id, creative_id, creative, impressions, clicks, CAST(spend AS DOUBLE) AS spend,
  issue FROM checked WHERE blank_creative""")
add("blank_by_client", lambda d: Q.blank_by_client(d).selectExpr(
    "client", "campaigns", "blank_rows", "impressions", "round(spend, 2) AS spend"), f"""
SELECT client, count(DISTINCT campaign_id) AS campaigns, {O.sums('blank_rows', 'impressions')},
  round(sum(spend), 2) AS spend FROM blank_camps GROUP BY client""")
add("creative_flags_grouped", Q.creative_flags_grouped, "SELECT * FROM grouped_flags")
add("id_name_conflict", Q.id_name_conflict, f"""
SELECT creative_id, count(DISTINCT creative) AS names, count(*) AS rows,
  {O.sums('impressions', 'spend')} FROM checked WHERE id_name_conflict GROUP BY 1""")
add("missing_preview_by_creative", Q.missing_preview_by_creative, f"""
SELECT {', '.join(Q.CREATIVE_KEYS)}, count(*) AS days, {O.sums('impressions', 'clicks', 'spend')}
FROM checked WHERE missing_preview GROUP BY ALL""")
add("creative_summary", R.creative_summary, "SELECT * FROM feed_summary")
add("creative_roster", P.creative_roster, "SELECT * FROM roster")
add("product_norms", P.product_norms, f"""
SELECT product, {O.ratio('sum(clicks)', 'sum(impressions)')} AS ctr, {O.sums('impressions')}
FROM named_rows WHERE lower(product) IN {O.texts(K.CREATIVE_PRODUCTS)} GROUP BY product""")
add("creative_winners", P.creative_winners, "SELECT * FROM winners")
add("creative_laggards", P.creative_laggards, "SELECT * FROM laggards")
add("creative_zero_click", P.creative_zero_click, "SELECT * FROM quiet")
add("creative_zero_conversion", P.creative_zero_conversion, "SELECT * FROM idle")
add("creative_fatigue", P.creative_fatigue, "SELECT * FROM tired")
add("single_creative_campaigns", P.single_creative_campaigns, f"""
SELECT *, {O.CTR} AS ctr FROM camps WHERE creatives = 1 AND impressions >= 10000""")
add("dominant_creatives", P.dominant_creatives, "SELECT * FROM dominants")
add("duplicate_names", P.duplicate_names, "SELECT * FROM dupes")
add("top_creatives", P.top_creatives, f"""
SELECT *, row_number() OVER (ORDER BY impressions DESC, {_ROSTER}) AS rank FROM roster""")
add("performance_counts", R.performance_counts, "SELECT * FROM perf_counts")
add("utm_by_placement", U.utm_by_placement, "SELECT * FROM tagged_placements")
add("utm_per_creative", U.utm_per_creative, "SELECT * FROM tagged_creatives")
add("utm_summary", U.utm_summary, "SELECT * FROM utm_slices")
add("utm_totals", U.utm_totals, """
SELECT (SELECT count(*) FROM tagged_creatives) AS creatives, count(*) AS placements,
  'creative ID' AS id_basis FROM url_placements""")
add("utm_params", U.utm_params, f"""
SELECT parameter, count(*) AS creatives, {O.sums('impressions')},
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tagged_creatives) AS pct_of_creatives
FROM (SELECT unnest(string_split(utm_params, ', ')) AS parameter, impressions
  FROM tagged_creatives WHERE utm_count > 0) GROUP BY parameter""")
add("utm_by_client", U.utm_by_client, f"""
SELECT *, creatives - tagged AS untagged, {O.ratio('tagged', 'creatives', 'NULL')} AS tagged_pct,
  {O.ratio('tagged_impressions', 'impressions')} AS tagged_impr_pct
FROM (SELECT client, count(*) AS creatives, count(*) FILTER (WHERE utm_count > 0) AS tagged,
    {O.sums('impressions')}, round(sum(spend), 2) AS spend,
    {O.n('impressions', 'utm_count > 0')} AS tagged_impressions
  FROM tagged_creatives GROUP BY client)""")
add("utm_untagged", U.utm_untagged, "SELECT * FROM tagged_creatives WHERE utm_count = 0")
add("utm_partial", U.utm_partial,
    "SELECT * FROM tagged_creatives WHERE status = 'partially tagged'")
add("utm_multi_url", U.utm_multi_url, "SELECT * FROM tagged_creatives WHERE distinct_urls > 1")
add("perf_by_size", Z.perf_by_size, f"""
SELECT *, CASE WHEN size = '(not specified)' THEN 'unknown'
  WHEN size IN {O.texts(K.BANNER_SIZES)} THEN 'IAB display'
  WHEN size IN {O.texts(K.SOCIAL_SIZES)} THEN 'social native' ELSE 'other' END AS family
FROM ({_rollup_sql(['size'])})""")
add("perf_by_type", Z.perf_by_type, _rollup_sql(["type"]))
add("perf_by_type_size", Z.perf_by_type_size, _rollup_sql(["product", "type", "size"]))
add("perf_by_product_size", Z.perf_by_product_size,
    f"SELECT * FROM ({_rollup_sql(['product', 'size'])}) WHERE impressions >= 5000")
add("video_completion", Z.video_completion, "SELECT * FROM completion")
add("low_completion", Z.low_completion,
    "SELECT * FROM completion WHERE impressions >= 5000 AND vcr < 0.5")
add("size_type_counts", Z.size_type_counts, "SELECT * FROM size_counts")
add("creative_alert_rows", creative_alert_rows, "SELECT * FROM alert_rows")
