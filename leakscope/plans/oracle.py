"""Reference results in SQL over the sample tables, for engines other than Spark.

Written independently of the operators: plain joins, correlated tests and window ranks where the
operators use conditional aggregates and scalar subqueries.
"""

import re

from leakscope.functions import constants as K


def fixed(x, digits):
    scale = 10**digits
    n = f"CAST(floor(({x}) * CAST({scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"
    return (f"(CAST({n} // {scale} AS VARCHAR) || '.' || "
            f"lpad(CAST({n} % {scale} AS VARCHAR), {digits}, '0'))")


def pct(x, digits):
    return f"({fixed(f'({x}) * CAST(100 AS DOUBLE)', digits)} || '%')"


def ratio(num, den, other="CAST(0 AS DOUBLE)"):
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE {other} END"


def cpm(spend="spend", impr="impressions"):
    return (f"CASE WHEN {impr} > 0 THEN CAST({spend} AS DOUBLE) / CAST({impr} AS DOUBLE) "
            f"* CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")


def n(x, where=None):
    return f"CAST(coalesce(sum({x}){f' FILTER (WHERE {where})' if where else ''}, 0) AS BIGINT)"


def money(x, where=None):
    return f"CAST(coalesce(sum({x}){f' FILTER (WHERE {where})' if where else ''}, 0) AS DOUBLE)"


def sums(*names):
    return ", ".join(
        f"{money(c) if c in ('spend', 'internal_cost', 'post_spend') else n(c)} AS {c}"
        for c in names
    )


def texts(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


KNOWN = texts(K.PLACEMENT_PRODUCTS)
OVERVIEW = texts(K.OVERVIEW_PRODUCTS)
NO_CLICK = texts(K.NO_CLICK_PLACEMENT_PRODUCTS)
PRODUCTS = (f"coalesce(string_agg(DISTINCT product, ', ' ORDER BY product) "
            f"FILTER (WHERE product IN {KNOWN}), '')")
CTR = ratio("clicks", "impressions")
DSP = "(dsp LIKE '%TTD%' OR dsp LIKE '%DV360%')"
GAMING = K.GAMING_APP.replace("(?iU)", "(?i)")
JUNK = K.JUNK_APP.replace("(?iU)", "(?i)")
UNRESOLVED = K.UNRESOLVED_APP.replace("(?iU)", "(?i)")


def day(c, missing):
    return f"coalesce(strftime({c}, '%Y-%m-%d'), '{missing}')"


def category_sql(name, what):
    """Placement rules as a CASE; `what` 0 gives the category, 1 the concern."""
    cases = " ".join(
        f"WHEN regexp_matches(trim({name}), '{rule[2].replace('(?iU)', '(?i)')}') "
        f"THEN '{rule[what]}'"
        for rule in K.PLACEMENT_RULES
    )
    blank, other = K.BLANK_PLACEMENT_RULE[what], K.OTHER_PLACEMENT_RULE[what]
    return (f"CASE WHEN coalesce(trim({name}), '') = '' THEN '{blank}' {cases} "
            f"ELSE '{other}' END")


CTES: dict[str, str] = {}

CTES["line_facts"] = """
SELECT l.*, s.s_name, s.s_nationkey, p.p_name, p.p_type, p.p_partkey,
  regexp_extract(p.p_brand, '(\\d+)', 1) AS brand_no, o.o_orderpriority, c.c_name,
  c.c_mktsegment, cn.n_name AS customer_nation,
  CAST(l_quantity AS BIGINT) * 1000 AS impr,
  replace(replace(p_name, 'gizmo', 'puzzle game'), 'bolt', 'flashlight')
    || CASE WHEN l_suppkey % 4 = 1 THEN ' pro' ELSE '' END AS app_name,
  'com.brand' || regexp_extract(p.p_brand, '(\\d+)', 1) || '.app' || CAST(p_partkey AS VARCHAR)
    AS bundle
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN part p ON l_partkey = p_partkey
JOIN supplier s ON l_suppkey = s_suppkey
"""
CTES["delivery"] = """
SELECT CAST(l_shipdate AS DATE) AS served_date, customer_nation AS business_unit,
  c_name AS client,
  CASE p_type WHEN 'ECONOMY' THEN 'Display' WHEN 'STANDARD' THEN 'Social Mirror'
    WHEN 'MEDIUM' THEN 'Video' WHEN 'LARGE' THEN 'CTV' WHEN 'SMALL' THEN 'Native Display'
    WHEN 'PROMO' THEN 'Online Audio' END AS product,
  o_orderpriority AS strategy_type, o_orderpriority || ' / ' || c_mktsegment AS strategy_name,
  CAST(l_orderkey AS VARCHAR) AS campaign_id,
  CASE WHEN l_linenumber <= 4 THEN 'site' ELSE 'app' END AS placement_type,
  CASE WHEN l_linenumber <= 4 THEN s_name ELSE app_name END AS placement,
  CASE WHEN l_linenumber <= 4 THEN s_name ELSE bundle END AS app_id,
  CASE WHEN l_suppkey % 5 = 2 THEN 'TTD/DV360' ELSE 'direct' END AS dsp,
  CASE WHEN l_linenumber <= 4 THEN s_name ELSE app_name || ' (' || bundle || ')' END AS raw_value,
  impr AS impressions,
  impr * (CASE WHEN l_suppkey % 10 = 0 THEN 40000 WHEN l_suppkey % 10 = 1 THEN 100
    WHEN p_type = 'LARGE' THEN 300 ELSE 3000 END) // 1000000 AS clicks,
  CAST(CASE WHEN l_returnflag = 'R' AND l_suppkey % 10 <> 1 THEN l_linenumber ELSE 0 END AS BIGINT)
    AS conversions,
  CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS view_throughs,
  CAST(l_extendedprice AS DECIMAL(18, 2)) AS spend,
  CAST(l_extendedprice AS DECIMAL(18, 2)) AS internal_cost,
  l_returnflag = 'A' AND l_suppkey % 4 = 1 AS is_block,
  CASE WHEN l_returnflag = 'A' AND l_suppkey % 4 = 1 THEN 'Block'
    WHEN l_linenumber <= 4 THEN s_name ELSE app_name END AS final,
  'EX-' || CAST(l_suppkey % 10 AS VARCHAR) AS exchange
FROM line_facts
"""
CTES["keyed"] = """
SELECT *, lower(trim(CASE WHEN placement_type = 'app' THEN app_id ELSE placement END)) AS match_key,
  CASE WHEN placement_type = 'app' THEN
    CASE WHEN lower(placement) = lower(app_id) THEN placement
    ELSE placement || ' - ' || app_id END ELSE placement END AS listed_name
FROM delivery WHERE impressions > 0
"""
CTES["bl_rows"] = """
SELECT s_name AS value, CASE s_suppkey % 4 WHEN 0 THEN 'All Products' WHEN 1 THEN 'CTV'
    WHEN 2 THEN 'Social Mirror' WHEN 3 THEN 'Audio' END AS tab,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN DATE '2002-06-01'
    ELSE DATE '1998-01-01' + CAST(s_suppkey AS INTEGER) END AS date_added
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1 OR s_suppkey % 8 = 3
UNION ALL
SELECT 'com.brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.app' || CAST(p_partkey AS VARCHAR),
  'All Products', DATE '1999-01-01' FROM part WHERE p_partkey % 50 = 0
"""
CTES["bl"] = """
SELECT lower(trim(value)) AS match_key, tab, min(date_added) AS date_added
FROM bl_rows GROUP BY ALL
"""
# A row of delivery is blocked by every tab that covers its product; the earliest one counts.
CTES["blocked_rows"] = """
SELECT k.*, (SELECT min(coalesce(b.date_added, DATE '1970-01-01')) FROM bl b
    WHERE b.match_key = k.match_key AND (b.tab = 'All Products'
      OR (k.product = 'CTV' AND b.tab = 'CTV') OR (k.product = 'Online Audio' AND b.tab = 'Audio')
      OR (k.product = 'Social Mirror' AND b.tab = 'Social Mirror'))) AS blocked_date
FROM keyed k WHERE k.match_key IN (SELECT match_key FROM bl)
"""
CTES["post_rows"] = """
SELECT *, CASE WHEN served_date > blocked_date THEN impressions ELSE 0 END AS post_impr,
  CASE WHEN served_date > blocked_date THEN spend ELSE 0 END AS post_spend FROM blocked_rows
"""
CTES["app_flagged"] = "SELECT DISTINCT placement FROM delivery WHERE is_block AND placement_type = 'app'"
CTES["site_flagged"] = "SELECT DISTINCT placement FROM delivery WHERE is_block AND placement_type = 'site'"


def _candidates(kind, key):
    return f"""
SELECT c.* FROM (
  SELECT min(placement) AS name, min(app_id) AS app_id, {PRODUCTS} AS products,
    {sums('impressions', 'clicks', 'conversions', 'spend')}, bool_or({DSP}) AS ttddv,
    max(raw_value) AS raw_value, lower({key}) AS mk
  FROM delivery WHERE placement_type = '{kind}' AND NOT is_block AND impressions > 0
  GROUP BY {key}) c
WHERE name NOT IN (SELECT placement FROM {kind}_flagged) AND NOT (
  mk IN (SELECT match_key FROM bl) AND NOT EXISTS (
    SELECT 1 FROM delivery d WHERE d.placement_type = '{kind}' AND NOT d.is_block
      AND d.impressions > 0 AND d.product IN {KNOWN} AND lower(d.{key}) = c.mk
      AND NOT EXISTS (SELECT 1 FROM bl b WHERE b.match_key = c.mk AND (b.tab = 'All Products'
        OR (d.product = 'CTV' AND b.tab = 'CTV')
        OR (d.product = 'Online Audio' AND b.tab = 'Audio')
        OR (d.product = 'Social Mirror' AND b.tab = 'Social Mirror')))))
"""


CTES["cand_site"] = _candidates("site", "placement")
CTES["cand_app"] = _candidates("app", "app_id")
CTES["fam_members"] = """
SELECT name, app_id, impressions, trim(lower(name)) AS family,
  string_split(lower(app_id), '.')[1] || '.' || string_split(lower(app_id), '.')[2] AS developer
FROM cand_app WHERE regexp_matches(lower(app_id), '^[a-z][a-z0-9_]*(\\.[a-z0-9_]+){2,}$')
"""
CTES["families"] = f"""
SELECT family, count(DISTINCT developer) AS developers, {n('impressions')} AS family_impressions
FROM fam_members GROUP BY family HAVING count(DISTINCT developer) >= 3 AND sum(impressions) >= 2500
"""
CTES["clones"] = """
SELECT m.family, m.app_id, m.name, m.impressions, f.developers, f.family_impressions
FROM fam_members m JOIN families f USING (family) WHERE m.impressions >= 100
"""
CTES["auto_apps"] = f"""
SELECT * EXCLUDE (junk, developers, family_impressions),
  coalesce(junk, CASE WHEN developers IS NOT NULL THEN 'Clone-family app' END) AS category,
  CASE junk WHEN 'Unresolved bundle' THEN 'unidentifiable app (raw bundle/ID)'
    WHEN 'Gaming app' THEN 'gaming inventory (block-by-default)'
    WHEN 'Junk app' THEN 'low-value utility/photo/junk app'
    ELSE CAST(developers AS VARCHAR) || ' different developers ship apps under this name ('
      || format('{{:,}}', family_impressions) || ' family impressions) — clone-farm inventory' END
    AS reason
FROM (SELECT a.name, a.app_id, products, a.impressions, clicks, {ratio('clicks', 'a.impressions')} AS ctr,
    spend, conversions, ttddv, raw_value,
    CASE WHEN regexp_matches(trim(a.name), '{UNRESOLVED}') THEN 'Unresolved bundle'
      WHEN regexp_matches(trim(a.name), '{GAMING}') THEN 'Gaming app'
      WHEN regexp_matches(trim(a.name), '{JUNK}') THEN 'Junk app' END AS junk,
    c.developers, c.family_impressions
  FROM cand_app a LEFT JOIN clones c ON a.app_id = c.app_id)
WHERE category IS NOT NULL
"""
CTES["click_sites"] = f"""
SELECT * FROM delivery WHERE placement_type = 'site' AND impressions > 0
  AND product NOT IN {NO_CLICK}
"""
CTES["site_norms"] = f"""
SELECT product, {ratio('sum(clicks)', 'sum(impressions)')} AS product_ctr FROM click_sites
GROUP BY product
"""
CTES["handled"] = """
SELECT lower(trim(placement)) AS k FROM site_flagged UNION SELECT match_key FROM bl
"""
CTES["low_by_client"] = f"""
SELECT business_unit, client, product, site, impressions, clicks, conversions, spend, ctr,
  product_ctr, x_over_norm, conv_rate, 'CTR ' || {pct('ctr', 3)} || ' is ' || {fixed('x_over_norm', 2)}
    || '× the ' || product || ' norm (' || {pct('product_ctr', 3)}
    || ') and below the 0.07% floor' AS reason
FROM (SELECT g.*, product_ctr, {ratio('ctr', 'product_ctr')} AS x_over_norm,
    {ratio('conversions', 'impressions')} AS conv_rate
  FROM (SELECT *, {CTR} AS ctr FROM (
      SELECT business_unit, client, product, placement AS site,
        {sums('impressions', 'clicks', 'conversions', 'spend')}
      FROM click_sites GROUP BY business_unit, client, product, placement)) g
  JOIN site_norms USING (product))
WHERE impressions >= 5000 AND product_ctr > 0 AND x_over_norm <= CAST(1 AS DOUBLE) / 3
  AND ctr <= CAST(0.0007 AS DOUBLE) AND conv_rate < CAST(0.0003 AS DOUBLE)
"""
CTES["low_all"] = f"""
SELECT name, name AS app_id, products, impressions, clicks, ctr, spend, conversions, ttddv,
  raw_value, 'Low CTR / no conv' AS category,
  'CTR ' || {pct('ctr', 3)} || ' with ' || CAST(conversions AS VARCHAR) || ' conversions across '
    || format('{{:,}}', impressions) || ' impressions (all clients)' AS reason
FROM (SELECT *, {CTR} AS ctr FROM (
  SELECT placement AS name, string_agg(DISTINCT product, ', ' ORDER BY product) AS products,
    {sums('impressions', 'clicks', 'conversions', 'spend')}, bool_or({DSP}) AS ttddv,
    max(raw_value) AS raw_value FROM click_sites GROUP BY placement))
WHERE impressions >= 10000 AND ctr <= CAST(0.0007 AS DOUBLE)
  AND {ratio('conversions', 'impressions')} < CAST(0.0003 AS DOUBLE)
"""
CTES["auto_low"] = "SELECT * FROM low_all WHERE lower(trim(name)) NOT IN (SELECT k FROM handled)"
CTES["high_all"] = f"""
SELECT *, 'CTR ' || {pct('ctr', 2)} || ' is ' || {fixed('x_over_norm', 1)} || '× the ' || products
    || ' norm — abnormally HIGH (possible invalid traffic)' AS reason
FROM (SELECT g.placement AS name, g.placement AS app_id, product AS products, impressions, clicks,
    ctr, spend, conversions, ttddv, raw_value, 'High CTR' AS category, product_ctr,
    {ratio('ctr', 'product_ctr')} AS x_over_norm
  FROM (SELECT *, {CTR} AS ctr FROM (
      SELECT placement, product, {sums('impressions', 'clicks', 'conversions', 'spend')},
        bool_or({DSP}) AS ttddv, max(raw_value) AS raw_value
      FROM click_sites GROUP BY placement, product)) g JOIN site_norms USING (product))
WHERE impressions >= 10000 AND ctr >= CAST(0.01 AS DOUBLE) AND product_ctr > 0
  AND x_over_norm >= 3
"""
CTES["auto_high"] = """
SELECT name, app_id, products, impressions, clicks, ctr, spend, conversions, ttddv, raw_value,
  category, reason
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY x_over_norm DESC, products) AS rn
  FROM high_all WHERE lower(trim(name)) NOT IN (SELECT k FROM handled))
WHERE rn = 1
"""
CTES["queue"] = """
SELECT kind, CAST((rn - 1) // 50 AS INTEGER) AS batch, CAST((rn - 1) % 50 + 1 AS INTEGER) AS line,
  name, app_id, products, impressions, clicks, conversions, spend, ttddv, raw_value
FROM (SELECT *, row_number() OVER (PARTITION BY kind
    ORDER BY impressions DESC, app_id, name) AS rn
  FROM (SELECT 'site' AS kind, * FROM cand_site UNION ALL SELECT 'app', * FROM cand_app))
"""
CTES["verdict_rows"] = f"""
SELECT kind, name, app_id, products, impressions, clicks, {CTR} AS ctr, spend, conversions,
  ttddv, raw_value, CASE WHEN line % 2 = 0 THEN 'MFA' ELSE 'Brand safety' END AS category,
  'line ' || CAST(line AS VARCHAR) AS reason
FROM queue WHERE line % 7 = 0 AND (kind, batch, line) IN (
  SELECT CASE WHEN slot < 200 THEN 'site' ELSE 'app' END, slot % 200 // 50, slot % 50 + 1
  FROM (SELECT p_partkey * 7 % 400 AS slot FROM part))
"""


def _merged(parts):
    """Merge block lists by window ranks: the first list's row, the others' categories."""
    union = " UNION ALL ".join(
        f"SELECT {i} AS p, name, app_id, products, impressions, clicks, ctr, spend, ttddv, "
        f"raw_value, category, reason FROM {src}"
        for i, src in enumerate(parts)
    )
    return f"""
SELECT name, f.app_id, products, impressions, clicks, ctr, spend, ttddv, raw_value,
  f.category || coalesce((SELECT string_agg(' + ' || c, '' ORDER BY p) FROM (
      SELECT u.category AS c, min(u.p) AS p FROM u WHERE u.app_id = f.app_id AND u.p > f.p
        AND u.category <> f.category AND u.category <> '' GROUP BY u.category)), '') AS category,
  f.reason || coalesce((SELECT ' | Also: ' || string_agg(u.category || ': ' || u.reason, ' · '
      ORDER BY u.p) FROM u WHERE u.app_id = f.app_id AND u.p > f.p), '') AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY p) AS rn FROM u) f
WHERE rn = 1
""", union


_sites, _sites_union = _merged(
    ["(SELECT * FROM verdict_rows WHERE kind = 'site')", "auto_high", "auto_low"])
_apps, _apps_union = _merged(
    ["(SELECT * FROM verdict_rows WHERE kind = 'app')", "auto_apps"])
CTES["site_parts"] = _sites_union
CTES["app_parts"] = _apps_union
CTES["merged_sites"] = re.sub(r"\bu\b(?!\.)", "site_parts u", _sites)
CTES["merged_apps"] = re.sub(r"\bu\b(?!\.)", "app_parts u", _apps)
CTES["excl"] = """
SELECT 'https://www.' || s_name || '/x' AS value FROM supplier WHERE s_suppkey % 13 = 0
UNION ALL
SELECT 'com.brand' || regexp_extract(p_brand, '(\\d+)', 1) || '.app' || CAST(p_partkey AS VARCHAR)
FROM part WHERE p_partkey % 13 = 0
"""
_FLOOR = ("(impressions >= 1000 OR category ILIKE '%gaming%' OR category LIKE '%High CTR%' "
          "OR category LIKE '%Low CTR%')")
CTES["recs"] = f"""
SELECT *, {cpm()} AS cpm, contains(category, 'Low CTR / no conv') AS is_low_ctr_block,
  concat_ws(' + ',
    CASE WHEN split_part(category, ' + ', 1) NOT IN ('High CTR', 'Low CTR / no conv')
      THEN 'Quality' END,
    CASE WHEN contains(category, 'High CTR') THEN 'High CTR' END,
    CASE WHEN contains(category, 'Low CTR / no conv') THEN 'Low CTR' END) AS flag
FROM (
  SELECT 'site' AS kind, * FROM merged_sites WHERE {_FLOOR} AND lower(name) NOT IN (
    SELECT regexp_extract(lower(value), '^https://www\\.([^/]*)', 1) FROM excl)
  UNION ALL
  SELECT 'app', * FROM merged_apps
  WHERE {_FLOOR} AND lower(app_id) NOT IN (SELECT lower(value) FROM excl))
"""
CTES["rec_keys"] = """
SELECT DISTINCT lower(CASE WHEN kind = 'app' THEN app_id ELSE name END) AS match_key FROM recs
"""
CTES["marked"] = """
SELECT k.*, match_key IN (SELECT match_key FROM rec_keys) AS is_rec FROM keyed k
"""
CTES["buyers"] = """
SELECT n_name AS business_unit, r_name AS buyer FROM nation JOIN region ON n_regionkey = r_regionkey
"""
CTES["units"] = f"""
SELECT *, {CTR} AS ctr, {ratio('internal_cost', 'conversions', 'NULL')} AS cost_per_conv,
  conversions = 0 AND internal_cost >= 300 AS zero_conversion_waste
FROM (SELECT business_unit,
    {sums('impressions', 'clicks', 'conversions', 'view_throughs', 'internal_cost')}
  FROM delivery GROUP BY business_unit)
"""


def _adjusted(grain):
    cols = ", ".join(grain)
    return f"""
SELECT {cols}, {ratio('sum(clicks) FILTER (WHERE NOT is_rec)', 'sum(impressions) FILTER (WHERE NOT is_rec)')}
    AS ctr_after_recs,
  {ratio('coalesce(sum(impressions) FILTER (WHERE is_rec), 0)', 'sum(impressions)')} AS pct_impr_on_recs
FROM marked GROUP BY {cols}
"""


CTES["adj_partner"] = _adjusted(["business_unit"])
CTES["adj_client"] = _adjusted(["client", "product"])
CTES["adj_strategy"] = _adjusted(["strategy_name"])


def _reason(label, norm):
    return (f"'CTR ' || {pct('ctr', 2)} || ' is ' || {fixed('x_over_norm', 1)} || '× the ' || "
            f"{label} || ' norm (' || {pct(norm, 2)} || ')'")


CTES["strategy_flags"] = f"""
SELECT business_unit, client, product, strategy_type, strategy_name, impressions, clicks,
  conversions, internal_cost, ctr, type_ctr, x_over_norm, {_reason('strategy_type', 'type_ctr')}
    AS reason, {cpm('internal_cost')} AS cpm
FROM (SELECT g.*, type_ctr, {ratio('ctr', 'type_ctr')} AS x_over_norm FROM (
    SELECT *, {CTR} AS ctr FROM (SELECT business_unit, client, product, strategy_type,
        strategy_name, {sums('impressions', 'clicks', 'conversions', 'internal_cost')}
      FROM delivery GROUP BY 1, 2, 3, 4, 5)) g
  JOIN (SELECT strategy_type, {ratio('sum(clicks)', 'sum(impressions)')} AS type_ctr
    FROM delivery GROUP BY strategy_type) USING (strategy_type))
WHERE impressions >= 5000 AND ctr >= CAST(0.005 AS DOUBLE) AND x_over_norm >= 3
"""
CTES["client_flags"] = f"""
SELECT business_unit, client, product, impressions, clicks, internal_cost, ctr, product_ctr,
  x_over_norm, {_reason('product', 'product_ctr')} AS reason, {cpm('internal_cost')} AS cpm
FROM (SELECT g.*, product_ctr, {ratio('ctr', 'product_ctr')} AS x_over_norm FROM (
    SELECT *, {CTR} AS ctr FROM (SELECT business_unit, client, product,
        {sums('impressions', 'clicks', 'internal_cost')} FROM delivery GROUP BY 1, 2, 3)) g
  JOIN (SELECT product, {ratio('sum(clicks)', 'sum(impressions)')} AS product_ctr
    FROM delivery GROUP BY product) USING (product))
WHERE impressions >= 20000 AND ctr >= CAST(0.008 AS DOUBLE) AND x_over_norm >= 3
"""
CTES["exchange_rows"] = f"""
SELECT g.*, product_ctr, {ratio('ctr', 'product_ctr')} AS x_over_norm,
  {ratio('conversions', 'impressions')} AS conv_rate
FROM (SELECT *, {CTR} AS ctr FROM (SELECT exchange, product,
    {sums('impressions', 'clicks', 'spend', 'conversions')} FROM delivery GROUP BY 1, 2)) g
JOIN (SELECT product, {ratio('sum(clicks)', 'sum(impressions)')} AS product_ctr
  FROM delivery GROUP BY product) USING (product)
"""
CTES["exchange_found"] = f"""
SELECT *, 'CTR ' || {pct('ctr', 3)} || ' is '
    || CASE side WHEN 'HIGH' THEN {fixed('x_over_norm', 1)} ELSE {fixed('x_over_norm', 2)} END
    || '× the ' || product || ' norm — abnormally '
    || CASE side WHEN 'HIGH' THEN 'HIGH (possible invalid traffic)'
      ELSE 'LOW (underdelivering, not converting)' END AS flag
FROM (SELECT *, CASE WHEN conv_rate >= CAST(0.0003 AS DOUBLE) THEN NULL
    WHEN spend >= 150 AND impressions >= 30000 AND x_over_norm >= 3 THEN 'HIGH'
    WHEN impressions > 30000 AND product_ctr > 0 AND x_over_norm <= CAST(1 AS DOUBLE) / 3
      AND product IN {texts(K.CLICK_EXCHANGE_PRODUCTS)} THEN 'LOW' END AS side FROM exchange_rows)
WHERE side IS NOT NULL
"""
CTES["leak"] = "SELECT * FROM delivery WHERE is_block AND impressions > 0"
CTES["top"] = f"""
SELECT name, placement_type, products, impressions, clicks, conversions, spend, blocked, ctr,
  {cpm()} AS cpm,
  CASE WHEN date_diff('day', last, (SELECT max(served_date) FROM delivery)) <= 1 THEN 'serving'
    ELSE 'stopped' END AS serving, strftime(last, '%Y-%m-%d') AS last_served,
  CAST(impressions AS DOUBLE) / CAST((SELECT sum(impressions) FROM delivery) AS DOUBLE) AS pct_impr
FROM (SELECT *, {CTR} AS ctr FROM (
  SELECT placement AS name, placement_type, {PRODUCTS} AS products,
    {sums('impressions', 'clicks', 'conversions', 'spend')}, bool_or(is_block) AS blocked,
    max(served_date) AS last
  FROM delivery WHERE impressions > 0 GROUP BY placement, placement_type))
"""


def statement(body: str) -> str:
    """The body with every CTE it needs, in order of definition."""
    need: set[str] = set()

    def add(text):
        for name, sql in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(sql)

    add(body)
    with_ = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in need)
    return f"WITH {with_}\n{body.strip()}" if with_ else body.strip()
