"""Queries over placement, exchange and overview delivery, each with its SQL counterpart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions import labels
from leakscope.functions.creative import keys_present, site_domain
from leakscope.functions.constants import OTHER_TRACKING_KEYS, UTM_KEYS
from leakscope.operators import blocklist as B
from leakscope.operators import candidates as C
from leakscope.operators import exchange as E
from leakscope.operators import impact as I
from leakscope.operators import leak as L
from leakscope.operators import performance as V
from leakscope.operators import recommend as R
from leakscope.operators import scoring as G
from leakscope.plans import facts
from leakscope.plans import oracle as O
from leakscope.plans import sample as S
from leakscope.plans.stage import is_staged, staged
from leakscope.sources.dimensions import blocklist_by_key, blocklist_dim, buyer_dim, with_buyer

# The sample has no partner above the default click-rate tiers.
SAMPLE_TIERS = ((10000, 0.006), (30000, 0.006))


# --- shared inputs --------------------------------------------------------------------------


def key_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """The block list by key, written once: the planner then knows its size before it joins."""
    return staged(
        spark, sf, "blocklist",
        lambda: blocklist_by_key(blocklist_dim(S.blocklist_rows(spark, sf))))


def open_candidates(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return C.block_candidates(facts.recommending(spark, sf), kind, key_blocklist(spark, sf))


def candidates(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return staged(
        spark, sf, f"candidates_{kind}", lambda: open_candidates(spark, sf, kind))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return R.review_queue({k: candidates(spark, sf, k) for k in ("site", "app")})


def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.apply_verdicts(queue(spark, sf), S.verdicts(spark, sf))


def merged_sites(spark: SparkSession, sf: str) -> DataFrame:
    d = facts.recommending(spark, sf)
    handled = C.handled_site_keys(d, key_blocklist(spark, sf))
    return R.merge_site_blocks(
        verdict_rows(spark, sf).filter("kind = 'site'"),
        C.auto_high_ctr_site_blocks(d, handled), C.auto_low_ctr_site_blocks(d, handled),
    )


def merged_apps(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_app_blocks(
        verdict_rows(spark, sf).filter("kind = 'app'"),
        C.auto_app_blocks(candidates(spark, sf, "app")),
    )


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return staged(
        spark, sf, "recommendations", lambda: flagged_recommendations(spark, sf))


def flagged_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    excluded = S.exclusions(spark, sf)
    sites = R.drop_excluded(R.quality_floor(merged_sites(spark, sf)), "site", excluded)
    apps = R.drop_excluded(R.quality_floor(merged_apps(spark, sf)), "app", excluded)
    return R.with_flags(R.recommended(sites, apps))


def buyers(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.buyer_rows(spark, sf)
    return buyer_dim(rows.select("Partner", "Buyer", "id"), F.col("id"))


def keys_of(spark, sf):
    return R.recommended_keys(recommendations(spark, sf))


# --- queries --------------------------------------------------------------------------------

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, O.statement(sql) if sql else None)
        return fn

    return add


def simple(name: str, make, sql: str):
    """Register an operator that takes the delivery fact."""
    QUERIES[name] = (lambda spark, sf: make(facts.delivery(spark, sf)), O.statement(sql))


def on_placements(name: str, make, sql: str):
    """Register an operator that needs no partner, client or strategy."""
    QUERIES[name] = (lambda spark, sf: make(facts.placements(spark, sf)), O.statement(sql))


def on_performance(name: str, make, sql: str):
    QUERIES[name] = (lambda spark, sf: make(facts.performance(spark, sf)), O.statement(sql))


# performance

on_performance(
    "perf_by_business_unit",
    lambda f: V.perf_by_business_unit(f, tiers=SAMPLE_TIERS),
    "SELECT *, impressions >= 10000 AND ctr > CAST(0.006 AS DOUBLE) AS flagged FROM units",
)
on_performance("perf_by_product", V.perf_by_product, f"""
SELECT *, CAST(internal_cost AS DOUBLE) / (SELECT {O.money('internal_cost')} FROM delivery)
    AS pct_of_spend,
  ctr > (SELECT {O.ratio('sum(clicks)', 'sum(impressions)')} FROM delivery) AS above_norm
FROM (SELECT *, {O.CTR} AS ctr, {O.ratio('conversions', 'clicks')} AS click_conv_rate FROM (
  SELECT CASE WHEN product IN {O.OVERVIEW} THEN product ELSE 'Other/Uncategorized' END AS product,
    {O.sums('impressions', 'clicks', 'conversions', 'internal_cost')} FROM delivery GROUP BY 1))
""")
on_performance("perf_by_strategy", V.perf_by_strategy, f"""
SELECT *, ctr > (SELECT {O.ratio('sum(clicks)', 'sum(impressions)')} FROM delivery) AS above_norm
FROM (SELECT *, {O.CTR} AS ctr, {O.ratio('internal_cost', 'conversions', 'NULL')} AS cost_per_conv
  FROM (SELECT strategy_type,
      {O.sums('impressions', 'clicks', 'conversions', 'view_throughs', 'internal_cost')}
    FROM delivery GROUP BY 1))
""")
on_performance("strategy_ctr_flags", V.strategy_ctr_flags, "SELECT * FROM strategy_flags")
on_performance("client_ctr_flags", V.client_ctr_flags, "SELECT * FROM client_flags")
on_performance("insights_summary", V.insights_summary, f"""
SELECT {O.n('impressions')} AS total_impressions, {O.n('clicks')} AS total_clicks,
  {O.money('internal_cost')} AS total_cost,
  CAST(sum(internal_cost) FILTER (WHERE product = 'Social Mirror') AS DOUBLE)
    / CAST(sum(internal_cost) AS DOUBLE) AS social_mirror_pct_spend,
  CAST(sum(conversions) FILTER (WHERE product = 'Social Mirror') AS DOUBLE)
    / CAST(sum(clicks) FILTER (WHERE product = 'Social Mirror') AS DOUBLE)
    AS social_mirror_conv_rate,
  CAST(sum(clicks) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE) AS book_ctr,
  (SELECT count(*) FROM units) AS business_units,
  (SELECT count(*) FROM units WHERE zero_conversion_waste) AS zero_conv_bu_count,
  (SELECT coalesce(sum(internal_cost), 0.0) FROM units WHERE zero_conversion_waste)
    AS zero_conv_spend,
  (SELECT count(*) FROM strategy_flags) AS strategy_flag_count
FROM delivery
""")

# placement scoring


def scoring_export(spark, sf):
    rows = facts.delivery(spark, sf).select(
        "placement", "impressions", "clicks", "spend", "conversions", "business_unit", "product",
        "strategy_type")
    rows = rows.withColumnsRenamed(
        {"business_unit": "Client Business Unit", "strategy_type": "Strategy Type"})
    return G.scoring_columns(rows)


_SCORED = f"""
(SELECT placement, impressions, clicks, spend, conversions, business_unit, product,
  strategy_type AS strategy, {O.category_sql('placement', 0)} AS category,
  {O.category_sql('placement', 1)} AS concern FROM delivery)
"""


@query("placement_scores", f"""
SELECT placement, impressions, clicks, CAST(spend AS DOUBLE) AS spend, conversions, business_unit,
  product, strategy, category, concern FROM {_SCORED}""")
def placement_scores(spark, sf):
    scored = G.placement_scores(scoring_export(spark, sf))
    return scored.withColumn("spend", F.col("spend").cast("double"))


@query("block_list", f"""
SELECT placement, category, impressions, clicks, CAST(spend AS DOUBLE) AS spend, business_unit,
  product, strategy FROM {_SCORED} WHERE concern = 'BLOCK'""")
def block_list(spark, sf):
    return G.block_list(G.placement_scores(scoring_export(spark, sf)))


_WASTE = (f"{O.n('impressions')} AS blocked_impressions, {O.money('spend')} AS blocked_spend, "
          "count(DISTINCT placement) AS blocked_placements")
for _dim, _name in (("business_unit", "bu"), ("product", "product"), ("strategy", "strategy")):
    QUERIES[f"blocked_waste_by_{_name}"] = (
        lambda spark, sf, d=_dim: G.blocked_waste_by(scoring_export(spark, sf), d),
        O.statement(f"SELECT {_dim}, {_WASTE} FROM {_SCORED} WHERE concern = 'BLOCK' GROUP BY 1"),
    )
QUERIES["blocked_waste"] = (
    lambda spark, sf: G.blocked_waste(scoring_export(spark, sf)),
    O.statement(" UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS value, {_WASTE} FROM {_SCORED} "
        f"WHERE concern = 'BLOCK' GROUP BY 2" for d in G.DIMENSIONS)),
)


@query("block_report_summary", f"""
SELECT count(*) AS placements, count(*) FILTER (WHERE concern = 'BLOCK') AS block_count,
  {O.n('impressions', "concern = 'BLOCK'")} AS blocked_impressions,
  {O.money('spend', "concern = 'BLOCK'")} AS blocked_spend, true AS has_dimensions
FROM {_SCORED}""")
def block_report_summary(spark, sf):
    return G.block_report_summary(scoring_export(spark, sf))


# leak

on_placements("leak_by_type", L.leak_by_type, f"""
SELECT placement_type, count(*) AS rows, count(DISTINCT placement) AS placements,
  {O.sums('impressions', 'spend')} FROM leak GROUP BY 1""")
on_placements("leak_offenders", L.leak_offenders, f"""
SELECT placement, placement_type, impressions, clicks, conversions, spend, ctr,
  strftime(last, '%Y-%m-%d') AS last_served, CAST(days AS INTEGER) AS days_since_last,
  days <= 1 AS still_active
FROM (SELECT *, {O.CTR} AS ctr, date_diff('day', last, (SELECT max(served_date) FROM delivery)) AS days
  FROM (SELECT placement, placement_type, {O.sums('impressions', 'clicks', 'conversions', 'spend')},
      max(served_date) AS last FROM leak GROUP BY 1, 2))""")
_LEAK = (f"{O.n('impressions')} AS leaked_impressions, {O.n('clicks')} AS leaked_clicks, "
         f"{O.ratio('sum(clicks)', 'sum(impressions)')} AS ctr, "
         f"{O.n('conversions')} AS leaked_conversions, {O.money('spend')} AS leaked_spend, "
         "count(DISTINCT placement) AS placements")
for _dim, _name in zip(L.LEAK_DIMENSIONS, ("bu", "client", "product", "strategy")):
    simple(f"leak_by_{_name}", lambda d, dim=_dim: L.leak_by(d, dim),
           f"SELECT {_dim}, {_LEAK} FROM leak GROUP BY 1")
simple("leak_rollups", L.leak_rollups, " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {_LEAK} FROM leak GROUP BY 2"
    for d in L.LEAK_DIMENSIONS))
on_placements("flagged_block_names", L.flagged_block_names,
       "SELECT DISTINCT placement_type, placement FROM delivery WHERE is_block")
on_placements("leak_summary", L.leak_summary, f"""
SELECT {O.money('spend')} AS leaked_spend, {O.n('impressions')} AS leaked_impressions,
  count(DISTINCT placement) AS leaked_placements, count(*) AS leaked_rows,
  CAST(0 AS BIGINT) AS unresolved_placements, CAST(0 AS DOUBLE) AS unresolved_spend,
  (SELECT strftime(min(served_date), '%Y-%m-%d') FROM delivery) AS window_start,
  (SELECT strftime(max(served_date), '%Y-%m-%d') FROM delivery) AS window_end,
  (SELECT count(*) FROM (SELECT placement, placement_type FROM leak GROUP BY 1, 2
    HAVING max(served_date) >= (SELECT max(served_date) FROM delivery) - 1)) AS active_placements,
  (SELECT {O.money('s')} FROM (SELECT sum(spend) AS s FROM leak GROUP BY placement, placement_type
    HAVING max(served_date) >= (SELECT max(served_date) FROM delivery) - 1)) AS active_spend,
  true AS has_dates
FROM leak""")
on_placements("top_placements", L.top_placements, "SELECT * FROM top")
on_placements("delivery_by_placement_product", L.delivery_by_placement_product, f"""
SELECT match_key, placement_type, product, {O.sums('impressions', 'spend')} FROM keyed
WHERE product IN {O.KNOWN} GROUP BY 1, 2, 3""")
simple("delivery_by_placement_strategy", L.delivery_by_placement_strategy, f"""
SELECT match_key, strategy_type, {O.sums('impressions', 'spend')} FROM keyed GROUP BY 1, 2""")
simple("watchlist_source", L.watchlist_source, f"""
SELECT match_key, business_unit, client, product, strategy_name,
  {O.sums('impressions', 'clicks')} FROM keyed GROUP BY 1, 2, 3, 4, 5""")

# candidates and automatic blocks

for _kind in ("site", "app"):
    QUERIES[f"block_candidates_{_kind}"] = (
        lambda spark, sf, k=_kind: open_candidates(spark, sf, k),
        O.statement(f"SELECT * EXCLUDE (mk) FROM cand_{_kind}"),
    )
_BLOCK = ", ".join(C.BLOCK_COLUMNS)


@query("auto_app_blocks", f"SELECT {_BLOCK} FROM auto_apps")
def auto_app_blocks(spark, sf):
    return C.auto_app_blocks(candidates(spark, sf, "app"))


@query("clone_families", "SELECT * FROM clones")
def clone_families(spark, sf):
    return C.clone_families(candidates(spark, sf, "app"))


simple("low_ctr_sites_by_client", C.low_ctr_sites_by_client, "SELECT * FROM low_by_client")


@query("auto_low_ctr_site_blocks", f"SELECT {_BLOCK} FROM auto_low")
def auto_low(spark, sf):
    d = facts.placements(spark, sf)
    return C.auto_low_ctr_site_blocks(d, C.handled_site_keys(d, key_blocklist(spark, sf)))


@query("low_ctr_site_products", f"""
SELECT *, CAST(sum(CASE WHEN is_known THEN 0 ELSE 1 END) OVER (PARTITION BY name) AS BIGINT)
  AS other_products
FROM (SELECT placement AS name, product, product IN {O.KNOWN} AS is_known,
    {O.sums('impressions', 'clicks', 'conversions')}, CAST(sum(spend) AS DOUBLE) AS spend
  FROM (SELECT * REPLACE (CASE WHEN CAST(campaign_id AS BIGINT) % 3 = 0 THEN 'Line item ' || dsp
      ELSE product END AS product) FROM click_sites)
  WHERE placement IN (SELECT name FROM auto_low) GROUP BY 1, 2, 3)""")
def low_ctr_site_products(spark, sf):
    clicked = ~F.col("product").isin(*K.NO_CLICK_PLACEMENT_PRODUCTS)
    other = clicked & (F.col("campaign_id").cast("bigint") % 3 == 0)
    d = facts.placements(spark, sf).withColumn("product", F.when(
        other, F.concat(F.lit("Line item "), F.col("dsp"))).otherwise(F.col("product")))
    return C.low_ctr_site_products(d, auto_low(spark, sf))


@query("auto_high_ctr_site_blocks", f"SELECT {_BLOCK} FROM auto_high")
def auto_high(spark, sf):
    d = facts.placements(spark, sf)
    return C.auto_high_ctr_site_blocks(d, C.handled_site_keys(d, key_blocklist(spark, sf)))


# block list

@query("blocklist_sheet_audit", """
SELECT value, 'CTV' AS tabs, 'Composite value' AS issue,
  'Replace with "' || s_name || '.com"' AS suggestion
FROM (SELECT 'Old name (' || s_name || '.com)' AS value, s_name FROM supplier
  WHERE s_suppkey % 4 = 0)
UNION ALL
SELECT CASE s_suppkey % 4 WHEN 1 THEN 'www.' || s_name ELSE replace(s_name, '#', ' #') END, 'CTV',
  'Value mismatch', 'Delivery matches "' || lower(s_name) || '" — update the value'
FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND lower(s_name) IN (
  SELECT match_key FROM keyed WHERE placement_type = 'site')
""")
def blocklist_sheet_audit(spark, sf):
    dim = blocklist_dim(S.broken_blocklist_rows(spark, sf))
    return B.blocklist_sheet_audit(dim, facts.delivery(spark, sf))


_CHECK = f"""
(SELECT k.match_key, min(listed_name) AS name, min(placement_type) AS placement_type,
  {O.PRODUCTS} AS products, {O.sums('impressions', 'spend', 'post_impr', 'post_spend')},
  max(served_date) AS last FROM post_rows k GROUP BY k.match_key)
"""


@query("blocklist_check", f"""
SELECT c.match_key, name, placement_type, products, impressions, spend, post_impr, post_spend,
  lists, post_impr > 0 AS leaking, strftime(last, '%Y-%m-%d') AS last_served,
  {O.day('added', '—')} AS date_added, {O.cpm()} AS cpm
FROM {_CHECK} c JOIN (SELECT match_key, string_agg(DISTINCT tab, ', ' ORDER BY tab) AS lists,
  min(date_added) AS added FROM bl GROUP BY match_key) USING (match_key)""")
def blocklist_check(spark, sf):
    return B.blocklist_check(facts.delivery(spark, sf), key_blocklist(spark, sf))


@query("clients_on_blocked", f"""
SELECT *, {O.CTR} AS ctr, {O.cpm()} AS cpm FROM (
SELECT business_unit, client, strategy_name, campaign_id AS strategy_id,
  CASE WHEN bool_or({O.DSP}) THEN 'TTD/DV360' ELSE '' END AS dsp, {O.PRODUCTS} AS products,
  count(DISTINCT match_key) AS n_sites,
  count(DISTINCT match_key) FILTER (WHERE placement_type = 'site') AS n_site,
  count(DISTINCT match_key) FILTER (WHERE placement_type = 'app') AS n_app,
  {O.day("min(blocked_date) FILTER (WHERE blocked_date > DATE '1971-01-01')", '—')} AS date_added,
  strftime(max(served_date), '%Y-%m-%d') AS last_served,
  {O.sums('impressions', 'clicks', 'spend', 'post_impr', 'post_spend')}
FROM post_rows GROUP BY business_unit, client, strategy_name, campaign_id)""")
def clients_on_blocked(spark, sf):
    return B.clients_on_blocked(facts.delivery(spark, sf), key_blocklist(spark, sf))


@query("blocked_placements_by_client", """
SELECT DISTINCT business_unit, client, strategy_name, campaign_id AS strategy_id,
  listed_name AS site FROM post_rows""")
def blocked_placements_by_client(spark, sf):
    return B.blocked_placements_by_client(facts.delivery(spark, sf), key_blocklist(spark, sf))


_EXPOSURE = f"""
SELECT business_unit, {O.n('impressions')} AS blocked_impr,
  count(DISTINCT match_key) AS blocked_placements
FROM post_rows WHERE blocked_date IS NOT NULL GROUP BY 1
"""


@query("blocklist_exposure_by_bu", _EXPOSURE)
def blocklist_exposure_by_bu(spark, sf):
    return B.blocklist_exposure_by_bu(facts.delivery(spark, sf), key_blocklist(spark, sf))


@query("blocklist_check_summary", f"""
SELECT count(*) AS matched, count(*) FILTER (WHERE post_impr > 0) AS leaking_count,
  coalesce(sum(post_spend) FILTER (WHERE post_impr > 0), 0) AS leaking_spend FROM {_CHECK}""")
def blocklist_check_summary(spark, sf):
    return B.blocklist_check_summary(facts.delivery(spark, sf), key_blocklist(spark, sf))


@query("audit_flags", """
SELECT true AS has_conversions, (SELECT bool_or(app_id <> name) FROM cand_app) AS has_app_id,
  false AS no_strategy_id""")
def audit_flags(spark, sf):
    return B.audit_flags(facts.delivery(spark, sf), key_blocklist(spark, sf),
                         candidates(spark, sf, "app"))


# recommendations

_MERGED = ", ".join(R.MERGED_COLUMNS)
_RECS = f"kind, {_MERGED}, flag, is_low_ctr_block, cpm"
QUERIES["review_queue"] = (queue, O.statement("SELECT * FROM queue"))
QUERIES["apply_verdicts"] = (verdict_rows, O.statement("SELECT * FROM verdict_rows"))
QUERIES["merge_site_blocks"] = (
    merged_sites, O.statement(f"SELECT {_MERGED} FROM merged_sites"))
QUERIES["merge_app_blocks"] = (merged_apps, O.statement(f"SELECT {_MERGED} FROM merged_apps"))


@query("quality_floor", f"""
SELECT {_MERGED} FROM merged_apps WHERE impressions >= 400000 OR category ILIKE '%gaming%'""")
def quality_floor(spark, sf):
    return R.quality_floor(merged_apps(spark, sf), 400000)


@query("drop_excluded", f"""
SELECT 'site' AS kind, {_MERGED} FROM merged_sites WHERE lower(name) NOT IN (
  SELECT regexp_extract(lower(value), '^https://www\\.([^/]*)', 1) FROM excl)
UNION ALL SELECT 'app', {_MERGED} FROM merged_apps
WHERE lower(app_id) NOT IN (SELECT lower(value) FROM excl)""")
def drop_excluded(spark, sf):
    excluded = S.exclusions(spark, sf)
    return R.recommended(
        R.drop_excluded(merged_sites(spark, sf), "site", excluded),
        R.drop_excluded(merged_apps(spark, sf), "app", excluded),
    )


QUERIES["recommendation_flags"] = (
    flagged_recommendations, O.statement(f"SELECT {_RECS} FROM recs"))
for _flag, _name in (("High CTR", "rec_high"), ("Low CTR", "rec_low")):
    QUERIES[_name] = (
        lambda spark, sf, f=_flag: R.recommended_by_flag(recommendations(spark, sf), f),
        O.statement(f"SELECT {_RECS} FROM recs WHERE contains(flag, '{_flag}')"),
    )


@query("filter_strings", """
SELECT kind, CASE kind WHEN 'app' THEN app_id ELSE name END AS value, impressions,
  CASE kind WHEN 'app' THEN 'OR {App ID}="' || app_id || '"'
    ELSE 'OR {Site Domain}="' || name || '"' END AS clause FROM recs""")
def filter_strings(spark, sf):
    return R.filter_clauses(recommendations(spark, sf))


@query("recommendation_totals", f"""
SELECT kind, count(*) AS placements, {O.sums('impressions', 'clicks')} FROM recs GROUP BY kind""")
def recommendation_totals(spark, sf):
    return R.recommendation_totals(recommendations(spark, sf))


# impact

def _impact_sql(dim, where="true"):
    return f"""
SELECT *, {O.ratio('blocked_impr', 'total_impr')} AS pct_impr_blocked,
  {O.ratio('blocked_spend', 'total_spend')} AS pct_spend_blocked,
  {O.cpm('total_spend', 'total_impr')} AS cpm,
  {O.ratio('blocked_impr', 'total_impr')} >= 0.5 AS hot
FROM (SELECT {dim}, {O.n('impressions')} AS total_impr, {O.money('spend')} AS total_spend,
    count(DISTINCT match_key) AS total_placements, {O.n('impressions', 'is_rec')} AS blocked_impr,
    {O.money('spend', 'is_rec')} AS blocked_spend,
    count(DISTINCT match_key) FILTER (WHERE is_rec) AS blocked_placements
  FROM marked WHERE {where} GROUP BY 1)"""


for _dim, _name, _where, _fact in (
        ("product", "product", f"product IN {O.KNOWN}", facts.placements),
        ("strategy_type", "strategy", "true", facts.delivery)):
    QUERIES[f"block_impact_by_{_name}"] = (
        lambda spark, sf, d=_dim, f=_fact: I.block_impact(f(spark, sf), keys_of(spark, sf), d),
        O.statement(_impact_sql(_dim, _where)),
    )
def after_recs(spark, sf, grain=None):
    """Effect of the recommendations on the given grain, or on all grains worked out together.

    Where all have been written already, those are its rows.
    """
    whole = grain is None or is_staged(spark, sf, "after_recs")
    name, grains = ("after_recs", I.AFTER_GRAINS) if whole else (f"after_recs_{grain}", [grain])
    return staged(spark, sf, name, lambda: I.after_recs(
        facts.watched(spark, sf), keys_of(spark, sf), grains))


for _name in I.AFTER_GRAINS:
    QUERIES[f"ctr_after_recs_{_name}"] = (
        lambda spark, sf, g=_name: I.of_grain(after_recs(spark, sf, g), g),
        O.statement(f"SELECT * FROM adj_{_name}"),
    )


@query("partner_watchlist", f"""
SELECT u.*, coalesce(e.blocked_impr, 0) AS blocked_impr,
  coalesce(e.blocked_placements, 0) AS blocked_placements, a.ctr_after_recs, a.pct_impr_on_recs,
  b.buyer, {O.cpm('internal_cost')} AS cpm
FROM (SELECT * FROM units WHERE impressions >= 10000 AND ctr > CAST(0.006 AS DOUBLE)) u
LEFT JOIN ({_EXPOSURE}) e USING (business_unit) LEFT JOIN adj_partner a USING (business_unit)
LEFT JOIN buyers b USING (business_unit)""")
def partner_watchlist(spark, sf):
    d, bl = facts.watched(spark, sf), key_blocklist(spark, sf)
    perf = V.perf_by_business_unit(
        facts.performance(spark, sf, facts.watched), tiers=SAMPLE_TIERS)
    return I.partner_watchlist(
        perf, d, B.blocklist_exposure_by_bu(d, bl), buyers(spark, sf),
        after_recs(spark, sf, "partner"))


@query("client_watchlist", """
SELECT f.*, a.ctr_after_recs, a.pct_impr_on_recs, b.buyer FROM client_flags f
LEFT JOIN adj_client a USING (client, product) LEFT JOIN buyers b USING (business_unit)""")
def client_watchlist(spark, sf):
    flags = V.client_ctr_flags(facts.performance(spark, sf, facts.watched))
    return I.client_watchlist(flags, buyers(spark, sf), after_recs(spark, sf, "client"))


@query("strategy_watchlist", """
SELECT f.*, a.ctr_after_recs, a.pct_impr_on_recs, b.buyer FROM strategy_flags f
LEFT JOIN adj_strategy a USING (strategy_name) LEFT JOIN buyers b USING (business_unit)""")
def strategy_watchlist(spark, sf):
    flags = V.strategy_ctr_flags(facts.performance(spark, sf, facts.watched))
    return I.strategy_watchlist(flags, buyers(spark, sf), after_recs(spark, sf, "strategy"))


@query("low_ctr_account_blocked", f"""
SELECT *, lower(site) IN (SELECT lower(name) FROM auto_low) AS acct_blocked, {O.cpm()} AS cpm
FROM low_by_client""")
def low_ctr_account_blocked(spark, sf):
    d = facts.delivery(spark, sf)
    return I.low_ctr_account_blocked(C.low_ctr_sites_by_client(d), auto_low(spark, sf))


@query("top_cards", f"""
SELECT (SELECT strftime(min(served_date), '%b %d') || ' – ' || strftime(max(served_date), '%b %d')
    FROM delivery) AS date_range, {O.n('impressions')} AS impressions,
  {O.ratio('sum(clicks)', 'sum(impressions)')} AS ctr, {O.money('spend')} AS internal_cost,
  count(DISTINCT match_key) AS placements, (SELECT count(*) FROM recs) AS rec_placements,
  {O.money('spend', 'is_rec')} AS rec_spend, {O.n('impressions', 'is_rec')} AS rec_impr,
  {O.ratio('sum(impressions) FILTER (WHERE is_rec)', 'sum(impressions)')} AS rec_impr_pct
FROM marked""")
def top_cards(spark, sf):
    recs = recommendations(spark, sf)
    return I.top_cards(
        facts.performance(spark, sf), facts.delivery(spark, sf), recs, R.recommended_keys(recs))


@query("top_placements_flagged", "SELECT *, name IN (SELECT name FROM recs) AS rec FROM top")
def top_placements_flagged(spark, sf):
    return I.top_placements_flagged(facts.delivery(spark, sf), recommendations(spark, sf))


@query("buyer_lookup", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' || lower(n_name) ELSE n_name END
    AS business_unit, r_name AS buyer
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def buyer_lookup(spark, sf):
    rows = S.table(spark, sf, "customer").join(
        S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.lower("n_name")))
    partners = rows.select("c_custkey", name.otherwise(F.col("n_name")).alias("business_unit"))
    return with_buyer(partners, buyers(spark, sf))


# exchanges

def on_exchange(name, make, sql):
    QUERIES[name] = (lambda spark, sf: make(facts.exchange(spark, sf)), O.statement(sql))


on_exchange("exchange_table", E.exchange_table, f"""
SELECT *, {O.CTR} AS ctr, spend / (SELECT {O.money('spend')} FROM delivery) AS pct_of_spend
FROM (SELECT exchange, {O.sums('impressions', 'clicks', 'spend')} FROM delivery GROUP BY 1)""")
on_exchange("exchange_flags", E.exchange_flags, "SELECT * FROM exchange_found")
on_exchange("exchange_summary", E.exchange_summary, f"""
SELECT (SELECT count(DISTINCT exchange) FROM delivery) AS exchanges,
  (SELECT {O.ratio('sum(clicks)', 'sum(impressions)')} FROM delivery) AS book_ctr,
  (SELECT {O.money('spend')} FROM delivery) AS total_spend, exchange AS top_exchange,
  {O.money('spend')} / (SELECT {O.money('spend')} FROM delivery) AS top_share,
  (SELECT count(*) FROM exchange_found) AS flag_count,
  (SELECT coalesce(sum(spend), 0) FROM exchange_found) AS flag_spend
FROM delivery GROUP BY exchange ORDER BY sum(spend) DESC, exchange DESC LIMIT 1""")

# URL and label expressions over whole tables


@query("url_domains", """
SELECT page_id, url, regexp_replace(regexp_replace(split_part(split_part(
  regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '/', 1), '?', 1), '^www\\.', ''), '\\.+$', '')
  AS domain FROM pages""")
def url_domains(spark, sf):
    return S.table(spark, sf, "pages").select(
        "page_id", "url", site_domain(F.col("url")).alias("domain"))


def _keys_sql(keys):
    parts = ", ".join(f"CASE WHEN contains(lower(trim(url)), '{k}=') THEN '{k}' END" for k in keys)
    return f"concat_ws(', ', {parts})"


@query("url_tags", f"""
SELECT page_id, {_keys_sql(UTM_KEYS)} AS utm_params,
  {_keys_sql(OTHER_TRACKING_KEYS)} AS other_tracking FROM pages""")
def url_tags(spark, sf):
    url = F.col("url")
    return S.table(spark, sf, "pages").select(
        "page_id", keys_present(url, UTM_KEYS).alias("utm_params"),
        keys_present(url, OTHER_TRACKING_KEYS).alias("other_tracking"))


@query("report_labels", """
SELECT client, CASE WHEN a = b THEN strftime(a, '%Y-%m-%d')
    ELSE strftime(a, '%Y-%m-%d') || '_to_' || strftime(b, '%Y-%m-%d') END AS window_id,
  CASE WHEN a = b THEN strftime(a, '%m/%d/%y')
    ELSE strftime(a, '%m/%d/%y') || ' – ' || strftime(b, '%m/%d/%y') END AS report_name,
  CASE WHEN a = b THEN strftime(a, '%m.%d.%y')
    ELSE strftime(a, '%m.%d.%y') || '-' || strftime(b, '%m.%d.%y') END AS range_label
FROM (SELECT client, min(served_date) AS a, max(served_date) AS b FROM delivery GROUP BY client)""")
def report_labels(spark, sf):
    spans = facts.delivery(spark, sf).groupBy("client").agg(
        F.min("served_date").alias("a"), F.max("served_date").alias("b"))
    ids = spans.select("client", labels.window_id(F.col("a"), F.col("b")).alias("window_id"))
    return ids.select(
        "*", labels.report_name(F.col("window_id")).alias("report_name"),
        labels.range_label(F.col("window_id")).alias("range_label"))
