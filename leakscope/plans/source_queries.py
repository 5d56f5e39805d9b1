"""Queries for sources, sinks and streams. They write to and read from the shared folder."""

from pyspark.sql import functions as F

from leakscope.operators import blocklist as B
from leakscope.operators import creative_quality as Q
from leakscope.operators import impact as I
from leakscope.operators import leak as L
from leakscope.operators import performance as V
from leakscope.plans import facts
from leakscope.plans import oracle as O
from leakscope.plans import sample as S
from leakscope.plans.creative_queries import QUERIES as CREATIVE
from leakscope.plans.delivery_queries import (
    QUERIES as DELIVERY,
    after_recs,
    buyers,
    key_blocklist,
    keys_of,
)
from leakscope.plans.stage import fresh_path
from leakscope.sinks import tables as T
from leakscope.sources import exports as X
from leakscope.sources import files as M
from leakscope.sources.creatives import normalize_creative
from leakscope.sources.dimensions import read_blocklist, read_buyers
from leakscope.sources.pooling import pool_exports
from leakscope.streaming import incremental as T1

QUERIES: dict = {}

# Canonical export columns under plain names.
PLAIN = {
    "Date": "served_date", "Client Business Unit": "business_unit", "Client": "client",
    "Product 2": "product", "Strategy Type": "strategy_type", "Strategy Name": "strategy_name",
    "Campaign ID": "campaign_id", "Site Domain": "placement", "App Name": "placement",
    "Final Site Domain Name": "final", "Final App Name": "final", "App ID": "app_id",
    "Raw Value": "raw_value", "Impressions": "impressions", "Clicks": "clicks",
    "Post Click Conversions": "conversions", "Post View Conversions": "view_throughs",
    "Billable Spend": "spend", "DSP": "dsp",
}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, O.statement(sql) if sql else None)
        return fn

    return add


def plain(df, *extra):
    cols = [F.col(f"`{c}`").cast("double").alias(PLAIN[c]) if c == "Billable Spend"
            else F.col(f"`{c}`").alias(PLAIN.get(c, c)) for c in df.columns if c in PLAIN]
    return df.select(*cols, *extra)


def saved_csv(spark, schema, path):
    """A written CSV table with all its columns, typed; empty texts are quoted, nulls are not."""
    return spark.read.option("header", True).option("nullValue", "\x01").schema(schema).csv(path)


def csv_of(spark, df, name):
    path = fresh_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


_BASE = ("served_date, business_unit, client, product, strategy_type, strategy_name, campaign_id, "
         "placement, final, impressions, clicks, conversions, view_throughs, "
         "CAST(spend AS DOUBLE) AS spend, dsp")


@query("read_delivery_export", f"""
SELECT {_BASE}, app_id, raw_value FROM delivery WHERE placement_type = 'app'""")
def read_delivery_export(spark, sf):
    path = csv_of(spark, S.app_export(spark, sf), "app-export")
    return plain(X.read_delivery_export(spark, path))


@query("read_delivery_export_site", f"""
SELECT {_BASE} FROM delivery WHERE placement_type = 'site'""")
def read_delivery_export_site(spark, sf):
    path = csv_of(spark, S.site_export(spark, sf), "site-export")
    return plain(X.read_delivery_export(spark, path))


@query("read_creative_export", """
SELECT date, client, creative, creative_id, campaign_id, click_url, impressions,
  CAST(spend AS DOUBLE) AS spend, q100, conversions FROM creative_feed""")
def read_creative_export(spark, sf):
    feed = facts.creative(spark, sf).select(
        F.col("date"), F.col("client").alias("CLIENT"), F.col("creative").alias("ad_name"),
        F.col("creative_id").alias("Creative Id"), F.col("campaign_id").alias("campaign id"),
        F.col("click_url").alias("landing_page_url"), F.col("impressions").alias("Impressions"),
        F.col("spend").alias("billable_spend"), F.col("q100").alias("video_complete"),
        F.col("conversions").alias("Post-Click Conversions"), F.lit(1).alias("Budget"))
    path = fresh_path(spark, "creative-export")
    feed.write.parquet(path)
    rows = normalize_creative(X.read_creative_export(spark, path, "parquet"))
    return rows.select(
        "date", "client", "creative", "creative_id", "campaign_id", "click_url", "impressions",
        F.col("spend").cast("double").alias("spend"), "q100", "conversions")


@query("read_exchange_export", """
SELECT exchange, CASE WHEN l_linenumber % 2 = 0 THEN product ELSE '(all)' END AS product,
  impressions, clicks, conversions + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE view_throughs END
    AS conversions, CAST(spend AS DOUBLE) AS spend
FROM (SELECT *, CASE WHEN placement_type = 'site' THEN 1 ELSE 2 END AS l_linenumber FROM delivery)""")
def read_exchange_export(spark, sf):
    """One folder with two layouts: two conversion columns and no product; a product and one."""
    rows = facts.delivery(spark, sf)
    root = fresh_path(spark, "exchange-export")
    first = rows.filter("placement_type = 'site'").select(
        F.col("conversions").alias("Post-Click Conversions"), F.col("exchange").alias("Exchange"),
        F.col("view_throughs").alias("Post-View Conversions"), F.col("clicks").alias("Clicks"),
        F.col("impressions").alias("Impressions"), F.col("spend").alias("Billable Spend"))
    second = rows.filter("placement_type = 'app'").select(
        F.col("product").alias("PRODUCT 2"), F.col("spend").alias("media cost"),
        F.col("impressions").alias("impressions served"), F.col("clicks").alias("clicks"),
        F.col("conversions").alias("Conversions"), F.col("exchange").alias("exchange name"))
    for sheet in (first, second):
        sheet.write.mode("append").option("header", True).csv(root)
    sheets = X.read_exchange_export(spark, root)
    return sheets.withColumn("spend", F.col("spend").cast("double"))


@query("drop_total_row", """
SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE 'BU-' || CAST(o_orderkey % 7 AS VARCHAR) END
    AS business_unit, CAST(o_orderkey AS VARCHAR) AS client,
  CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS impressions,
  CASE WHEN o_orderkey % 10 = 1 THEN 0.0 ELSE CAST(o_orderkey % 13 AS DOUBLE) END AS clicks
FROM orders WHERE o_orderkey % 100 <> 0""")
def drop_total_row(spark, sf):
    return V.from_overview(X.drop_total_row(S.overview_sheet(spark, sf)))


@query("clean_app_identity", f"""
SELECT {_BASE}, app_id, raw_value FROM delivery WHERE placement_type = 'app'""")
def clean_app_identity(spark, sf):
    raw = S.app_export(spark, sf)
    named = X.canonical_columns(raw, X.DELIVERY_HEADERS, X.DELIVERY_COLUMNS)
    return plain(X.clean_app_identity(named))


_SPLIT = """
(SELECT value, stated, campaign_id, client, impressions, spend,
  CASE WHEN n % 4 = 3 AND placement_type = 'app' THEN app_id ELSE value END AS id,
  CASE WHEN n % 4 = 3 AND placement_type = 'app' THEN placement ELSE value END AS name,
  CASE WHEN value = 'cdn.desktop.aol.com' THEN true WHEN stated = 'In-app' THEN true
    WHEN stated = 'Web site' THEN false ELSE placement_type = 'app' END AS is_app
FROM (SELECT *, CASE WHEN placement_type = 'site' THEN lower(replace(placement, '#', '')) || '.com'
    WHEN n % 4 = 0 THEN 'id' || CAST(n + 1000000 AS VARCHAR) WHEN n % 4 = 1 THEN app_id
    WHEN n % 4 = 2 THEN 'cdn.desktop.aol.com' ELSE raw_value END AS value,
    CASE n % 10 WHEN 3 THEN 'Web site' WHEN 4 THEN 'In-app' ELSE '' END AS stated
  FROM (SELECT *, CAST(campaign_id AS BIGINT) AS n FROM delivery)))
"""


@query("split_combined_inventory", f"""
SELECT CASE WHEN is_app THEN 'app' ELSE 'site' END AS kind, id, CASE WHEN is_app THEN name ELSE id END
    AS name, value AS raw_value, 'TTD/DV360' AS dsp, campaign_id, client, impressions,
  CAST(spend AS DOUBLE) AS spend FROM {_SPLIT}""")
def split_combined_inventory(spark, sf):
    sites, apps = X.split_combined_inventory(S.combined_export(spark, sf))

    def rows(df, kind, identity, name):
        return df.select(
            F.lit(kind).alias("kind"), F.col(identity).alias("id"), F.col(name).alias("name"),
            F.col("`Raw Value`").alias("raw_value"), F.col("DSP").alias("dsp"),
            F.col("`Campaign ID`").alias("campaign_id"), F.col("Client").alias("client"),
            F.col("Impressions").alias("impressions"),
            F.col("`Billable Spend`").cast("double").alias("spend"))

    return rows(sites, "site", "`Site Domain`", "`Final Site Domain Name`").unionByName(
        rows(apps, "app", "`App ID`", "`App Name`"))


VERSION = ["file_date", "version_1", "version_2"]
_NEWEST = """
SELECT campaign_id, line, file_date, impressions, spend FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS campaign_id, CAST(l_linenumber AS VARCHAR) AS line,
    CAST(l_shipdate AS DATE) AS file_date, CAST(l_quantity AS BIGINT) * 1000 AS impressions,
    CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS spend,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
      l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem)
WHERE rn = 1
"""


def _pooled(df, *more):
    return df.select(
        *more,
        F.col("`Campaign ID`").alias("campaign_id"), F.col("`Strategy Name`").alias("line"),
        "file_date", F.col("Impressions").alias("impressions"),
        F.col("`Billable Spend`").cast("double").alias("spend"))


@query("pool_exports", _NEWEST)
def pool(spark, sf):
    rows = S.restated(spark, sf)
    halves = [rows.filter(F.col("version_2") % 2 == i) for i in (0, 1)]
    return _pooled(pool_exports(halves, VERSION))


@query("pool_creatives", """
SELECT creative, campaign_id, file_date, click_url, impressions, spend FROM (
  SELECT *, row_number() OVER (PARTITION BY creative, campaign_id ORDER BY file_date DESC,
    v1 DESC, v2 DESC, v3 DESC, v4 DESC, price DESC, impressions DESC) AS rn
  FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE p_name END AS creative,
      CAST(l_suppkey % 50 AS VARCHAR) AS campaign_id, CAST(l_shipdate AS DATE) AS file_date,
      'https://x.example.com/' || CAST(l_orderkey AS VARCHAR) AS click_url, l_orderkey AS v1,
      l_linenumber AS v2, l_partkey AS v3, l_suppkey AS v4, l_extendedprice AS price,
      CAST(l_quantity AS BIGINT) * 1000 AS impressions,
      CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS spend
    FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE rn = 1""")
def pool_creatives(spark, sf):
    rows = S.restated_creatives(spark, sf)
    halves = [rows.filter(F.col("version_1") % 2 == i) for i in (0, 1)]
    version = ["file_date", "version_1", "version_2", "version_3", "version_4"]
    pooled = pool_exports(halves, version)
    return pooled.select(
        F.col("`Creative Name`").alias("creative"), F.col("`Campaign ID`").alias("campaign_id"),
        "file_date", F.col("`Clickthrough URL`").alias("click_url"),
        F.col("Impressions").alias("impressions"),
        F.col("`Billable Spend`").cast("double").alias("spend"))


@query("filter_date_range", f"""
SELECT placement_type, count(*) AS rows, {O.sums('impressions', 'spend')} FROM delivery
WHERE served_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' GROUP BY 1""")
def filter_date_range(spark, sf):
    kept = X.filter_date_range(
        facts.delivery(spark, sf), "1998-01-01", "1999-06-30", "served_date")
    return kept.groupBy("placement_type").agg(
        F.count("*").alias("rows"), F.sum("impressions").alias("impressions"),
        F.sum("spend").cast("double").alias("spend"))


@query("latest_n_days", """
SELECT placement_type, served_date, placement, campaign_id, impressions FROM delivery
WHERE served_date > (SELECT max(served_date) FROM delivery) - 60""")
def latest_n_days(spark, sf):
    rows = facts.delivery(spark, sf).select(
        "placement_type", "served_date", "placement", "campaign_id", "impressions")
    sides = [rows.filter(F.col("placement_type") == k) for k in ("site", "app")]
    sites, apps = X.latest_days(sides, 60, "served_date")
    return sites.unionByName(apps)


def _overview(spark, sf, name):
    frames = X.overview_frames(
        *[X._typed(X.canonical_columns(e, X.DELIVERY_HEADERS, X.DELIVERY_COLUMNS))
          for e in (S.site_export(spark, sf), S.app_export(spark, sf))])
    out = V.from_overview(frames[name])
    return out.withColumn("internal_cost", F.col("internal_cost").cast("double"))


_OVERVIEW = O.sums("impressions", "clicks", "conversions", "view_throughs", "internal_cost")
QUERIES["overview_product"] = (
    lambda spark, sf: _overview(spark, sf, "product"),
    O.statement(f"SELECT business_unit, client, product, {_OVERVIEW} FROM delivery GROUP BY ALL"))
QUERIES["overview_strategy"] = (
    lambda spark, sf: _overview(spark, sf, "strategy"),
    O.statement(f"SELECT business_unit, client, product, strategy_type, strategy_name, "
                f"{_OVERVIEW} FROM delivery GROUP BY ALL"))

O.CTES["export_files"] = """
SELECT path, o_orderdate AS modified, CASE o_orderkey % 6 WHEN 0 THEN 'sites' WHEN 1 THEN 'apps'
    WHEN 2 THEN 'ttddv' WHEN 3 THEN 'creatives' ELSE 'sites' END AS kind,
  CASE WHEN regexp_matches(path, '_20[0-9]{6}_') THEN CAST(o_orderdate + INTERVAL 120 MONTH AS DATE)
    ELSE CAST(o_orderdate AS DATE) END AS file_date
FROM (SELECT *, 'exports/' || CASE o_orderkey % 6 WHEN 0 THEN 'site-domains' WHEN 1 THEN 'apps'
    WHEN 2 THEN 'ttddv-siteapp' WHEN 3 THEN 'creative_insights' WHEN 4 THEN 'notes'
    ELSE 'Site Domains' END || '_' || CASE WHEN o_orderkey % 9 = 0 THEN 'latest'
    ELSE strftime(o_orderdate + INTERVAL 120 MONTH, '%Y%m%d') END || '_n'
    || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 17 = 0 THEN '.txt' ELSE '.csv' END
    AS path FROM orders)
WHERE o_orderkey % 6 <> 4 AND o_orderkey % 17 <> 0
"""
O.CTES["range_files"] = """
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file_date DESC, modified DESC, path DESC)
  AS newest, count(*) OVER (PARTITION BY kind) AS n
FROM export_files WHERE file_date BETWEEN DATE '2006-03-01' AND DATE '2006-04-20' + 8
"""


@query("file_inventory", """
SELECT *, sites > 0 AND apps > 0 AS complete FROM (
  SELECT file_date, count(*) FILTER (WHERE kind = 'sites') AS sites,
    count(*) FILTER (WHERE kind = 'apps') AS apps, count(*) FILTER (WHERE kind = 'ttddv') AS ttddv,
    count(*) FILTER (WHERE kind = 'creatives') AS creatives FROM export_files GROUP BY file_date)""")
def file_inventory(spark, sf):
    return M.file_inventory(facts.manifest(spark, sf))


@query("select_range_files", """
SELECT kind, path, file_date, modified, CAST(NULL AS VARCHAR) AS reason
FROM range_files WHERE (SELECT count(DISTINCT kind) FROM range_files WHERE kind IN ('sites', 'apps')) = 2
UNION ALL
SELECT NULL, NULL, NULL, NULL, 'no site and app files in the window'
WHERE (SELECT count(DISTINCT kind) FROM range_files WHERE kind IN ('sites', 'apps')) < 2""")
def select_range_files(spark, sf):
    return M.select_range_files(facts.manifest(spark, sf), "2006-04-20", "2006-03-01")


@query("newest_file_per_kind", """
SELECT kind, path, modified FROM (SELECT *, row_number() OVER (PARTITION BY kind
  ORDER BY modified DESC, path DESC) AS rn FROM export_files) WHERE rn = 1""")
def newest_file_per_kind(spark, sf):
    return M.newest_file_per_kind(facts.manifest(spark, sf))


@query("blocklist_dim", """
SELECT match_key, tab, value, date_added FROM (
  SELECT lower(trim(value)) AS match_key, tab, min(value) AS value, min(date_added) AS date_added
  FROM bl_rows GROUP BY 1, 2)""")
def blocklist(spark, sf):
    return read_blocklist(spark, written_tabs(
        spark, S.blocklist_rows(spark, sf), ("All Products", "CTV", "Social Mirror", "Audio")))


@query("blocklist_dim_four_tabs", """
SELECT lower(trim(value)) AS match_key, tab, min(value) AS value, min(date_added) AS date_added
FROM (SELECT * FROM bl_rows UNION ALL
  SELECT s_name, 'Audio', CASE WHEN s_suppkey % 3 = 0 THEN NULL
    WHEN s_suppkey % 7 = 0 THEN DATE '2002-06-01'
    ELSE DATE '1998-01-01' + CAST(s_suppkey AS INTEGER) END
  FROM supplier WHERE s_suppkey % 4 = 3) GROUP BY 1, 2""")
def blocklist_four_tabs(spark, sf):
    rows = S.blocklist_rows(spark, sf).unionByName(S.audio_blocklist_rows(spark, sf))
    return read_blocklist(spark, written_tabs(
        spark, rows, ("All Products", "CTV", "Social Mirror", "Audio")))


def written_tabs(spark, rows, tabs):
    """Each tab of the block list as a sheet of its own, with the dates as that sheet has them."""
    sheet = F.concat(
        F.lit("Date("), F.year("date_added").cast("string"), F.lit(","),
        (F.month("date_added") - 1).cast("string"), F.lit(","),
        F.dayofmonth("date_added").cast("string"), F.lit(")"))
    written = F.when(F.col("tab") == "CTV", sheet).when(
        F.col("tab") == "All Products", F.date_format("date_added", "M/d/yyyy")).otherwise(
        F.date_format("date_added", "yyyy-MM-dd"))
    empty = F.lit("")
    paths = {}
    for tab in tabs:
        part = rows.filter(F.col("tab") == tab).select(
            F.lit("x").alias("a"), "value", empty.alias("c"), empty.alias("d"),
            F.coalesce(written, empty).alias("e"))
        header = part.limit(1).select(
            F.lit("Name").alias("a"), F.lit("Domain or App").alias("value"),
            F.lit("Type").alias("c"), F.lit("Formatted").alias("d"), F.lit("Date added").alias("e"))
        paths[tab] = fresh_path(spark, "blocklist")
        header.unionByName(part).write.csv(paths[tab])
    return paths


@query("buyer_dim", """
SELECT CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS partner,
  r_name AS buyer FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END FROM customer""")
def buyer_map(spark, sf):
    named = S.buyer_rows(spark, sf).select("Partner", "Buyer")
    more = S.table(spark, sf, "customer").select(
        F.col("c_name").alias("Partner"),
        F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("Buyer"))
    return read_buyers(spark, csv_of(spark, named.unionByName(more), "buyers"))


@query("normalize_delivery", """
SELECT served_date, business_unit, client, product, strategy_type, strategy_name,
  '(not in export)' AS campaign, campaign_id, placement_type, placement, app_id,
  placement AS display, dsp, CASE WHEN placement_type = 'app' THEN raw_value ELSE '' END AS raw_value,
  final, impressions, clicks, conversions + view_throughs AS conversions,
  CAST(spend AS DOUBLE) AS spend, is_block, false AS is_unresolved, true AS has_conversions
FROM delivery""")
def normalize_delivery(spark, sf):
    def canonical(df):
        return X.clean_app_identity(
            X._typed(X.canonical_columns(df, X.DELIVERY_HEADERS, X.DELIVERY_COLUMNS)))

    sites = X.normalize_delivery(canonical(S.site_export(spark, sf)), "site")
    apps = X.normalize_delivery(canonical(S.app_export(spark, sf)), "app")
    both = sites.unionByName(apps)
    return both.withColumn("spend", F.col("spend").cast("double"))


# --- sinks ----------------------------------------------------------------------------------


def sql_of(name):
    return (DELIVERY | CREATIVE)[name][1]


def by_name(parts: dict, column: str):
    """Tables of different columns as one, with their names in `column`."""
    out = None
    for name, df in parts.items():
        rows = df.withColumn(column, F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def by_name_sql(parts: dict, column: str) -> str:
    return " UNION ALL BY NAME ".join(
        f"SELECT '{name}' AS {column}, * FROM ({sql})" for name, sql in parts.items())


@query("write_tables", by_name_sql(
    {"offenders": sql_of("leak_offenders"), "by_type": sql_of("leak_by_type")}, "table_name"))
def write_tables(spark, sf):
    return by_name({n: both_copies(spark, sf, n) for n in ("offenders", "by_type")}, "table_name")


@query("write_tables_offenders", f"SELECT * FROM ({sql_of('leak_offenders')})")
def write_tables_offenders(spark, sf):
    return both_copies(spark, sf, "offenders")


@query("write_tables_by_type", f"SELECT * FROM ({sql_of('leak_by_type')})")
def write_tables_by_type(spark, sf):
    return both_copies(spark, sf, "by_type")


def both_copies(spark, sf, name):
    """The CSV copy of a written table, and what the Parquet copy holds besides."""
    d = facts.placements(spark, sf)
    root = fresh_path(spark, "tables")
    T.write_tables({"offenders": L.leak_offenders(d), "by_type": L.leak_by_type(d)}, root)
    saved = spark.read.parquet(f"{root}/parquet/{name}")
    typed = saved_csv(spark, saved.schema, f"{root}/csv/{name}")
    return typed.unionAll(saved.exceptAll(typed))


@query("write_report_window", """
SELECT placement_type, CAST(sum(impressions) AS BIGINT) AS impressions,
  CASE WHEN served_date < DATE '1999-01-01' THEN 'early' ELSE 'late' END AS window_id
FROM delivery GROUP BY 1, 3""")
def write_report_window(spark, sf):
    path = fresh_path(spark, "report")
    late = F.col("served_date") >= F.lit("1999-01-01").cast("date")
    rows = facts.delivery(spark, sf).groupBy(
        "placement_type", F.when(late, "late").otherwise("early").alias("w")
    ).agg(F.sum("impressions").alias("impressions"))
    for window in ("early", "late", "early"):
        T.write_report_window(rows.filter(F.col("w") == window).drop("w"), path, window)
    return spark.read.parquet(path)


# Watch lists and the queries whose rows they hold.
WATCHLISTS = {
    "partner": "partner_watchlist", "client": "client_watchlist",
    "strategy": "strategy_watchlist", "low_ctr_sites": "low_ctr_account_blocked",
    "clients_on_blocked": "clients_on_blocked",
}


def written_watchlist(spark, sf, name):
    """A watch list as it is read back, with all its columns."""
    rows = DELIVERY[WATCHLISTS[name]][0](spark, sf)
    root = fresh_path(spark, "watchlists")
    T.watchlist_export({name: rows}, root, buyers(spark, sf))
    return saved_csv(
        spark, T.watchlist_columns(rows, buyers(spark, sf)).schema, f"{root}/{name}")


_WATCHLIST_SQL = {}
for _name, _of in WATCHLISTS.items():
    _rows = f"({sql_of(_of)})"
    if _of in ("low_ctr_account_blocked", "clients_on_blocked"):
        _rows = (f"(SELECT w.*, coalesce(b.buyer, '') AS buyer FROM {_rows} w "
                 "LEFT JOIN buyers b USING (business_unit))")
    _WATCHLIST_SQL[_name] = f"""
SELECT buyer, false AS buyer_review,
  COLUMNS(lambda c: c NOT IN ('buyer', 'buyer_review', 'flagged')) FROM {_rows}"""
    query(f"watchlist_export_{_name}", _WATCHLIST_SQL[_name])(
        lambda spark, sf, n=_name: written_watchlist(spark, sf, n))


@query("watchlist_export", by_name_sql(_WATCHLIST_SQL, "watchlist"))
def watchlist_export(spark, sf):
    """All lists written at once and read back with all their columns."""
    facts.delivery(spark, sf)  # one of the lists needs all of it, so the others read it as well
    after_recs(spark, sf)  # three of them need a grain each, which one scan gives
    lists = {name: DELIVERY[of][0](spark, sf) for name, of in WATCHLISTS.items()}
    dim, root = buyers(spark, sf), fresh_path(spark, "watchlists")
    T.watchlist_export(lists, root, dim)
    return by_name(
        {name: saved_csv(spark, T.watchlist_columns(df, dim).schema, f"{root}/{name}")
         for name, df in lists.items()}, "watchlist")


# Findings and the queries whose rows they hold.
FINDINGS = {
    "blank_campaigns": "blank_campaigns", "blank_rows": "blank_rows",
    "winners": "creative_winners", "no_utm": "creative_check_rows_no_utm",
}


def written_finding(spark, sf, name):
    """A finding as it is read back, with all its columns."""
    rows = CREATIVE[FINDINGS[name]][0](spark, sf)
    root = fresh_path(spark, "findings")
    T.creative_findings_export({name: rows}, {}, root)
    return saved_csv(spark, rows.schema, f"{root}/{name}")


@query("creative_findings_export", by_name_sql(
    {name: sql_of(of) for name, of in FINDINGS.items()}, "finding"))
def creative_findings_export(spark, sf):
    """All findings written at once and read back; one without rows is not written."""
    rows = {name: CREATIVE[of][0](spark, sf) for name, of in FINDINGS.items()}
    none = Q.blank_campaigns_delivering(facts.creative(spark, sf), 10**15)
    root = fresh_path(spark, "findings")
    names = T.creative_findings_export(rows | {"nothing": none}, {}, root)
    return by_name({n: saved_csv(spark, rows[n].schema, f"{root}/{n}") for n in names}, "finding")


for _name, _of in FINDINGS.items():
    query(f"creative_findings_export_{_name}", f"SELECT * FROM ({sql_of(_of)})")(
        lambda spark, sf, n=_name: written_finding(spark, sf, n))


@query("exclusion_table", """
SELECT lower(value) AS value, CASE WHEN contains(value, 'https') THEN 'site' ELSE 'app' END AS kind
FROM excl WHERE contains(value, 'https')""")
def exclusion_table(spark, sf):
    path = fresh_path(spark, "exclusions")
    kind = F.when(F.col("value").contains("https"), "site").otherwise("app")
    rows = S.exclusions(spark, sf).withColumn("kind", kind).withColumn(
        "status", F.lit("excluded"))
    T.append_exclusions(rows, path, "2026-01-01")
    # The second review pushes the apps to the block list, so only the sites stay excluded.
    pushed = rows.filter(F.col("kind") == "app").withColumn("status", F.lit("pushed"))
    T.append_exclusions(pushed, path, "2026-01-02")
    return T.current_exclusions(spark, path)


@query("serving_block_export", """
SELECT business_unit, client, strategy_name, strategy_id, date_added, last_served,
  CAST(n_sites AS VARCHAR) AS n_sites, CAST(post_impr AS VARCHAR) AS post_impr
FROM (""" + sql_of("clients_on_blocked") + ")")
def serving_block_export(spark, sf):
    rows = B.clients_on_blocked(facts.delivery(spark, sf), key_blocklist(spark, sf))
    path = fresh_path(spark, "serving-block")
    T.serving_block_export(rows, path)
    saved = spark.read.option("header", True).csv(path)
    return saved.select("business_unit", "client", "strategy_name", "strategy_id", "date_added",
                        "last_served", "n_sites", "post_impr")


# --- streams --------------------------------------------------------------------------------


# The delivery date of a line: the week in which its order was placed.
_POOLED_WEEKS = """
SELECT served_date, campaign_id, line, file_date, impressions, spend FROM (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS served_date,
    CAST(l_orderkey AS VARCHAR) AS campaign_id, CAST(l_linenumber AS VARCHAR) AS line,
    CAST(l_shipdate AS DATE) AS file_date, CAST(l_quantity AS BIGINT) * 1000 AS impressions,
    CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS spend,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
      l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE rn = 1
"""


@query("incremental_pool", _POOLED_WEEKS)
def incremental_pool(spark, sf):
    """Files arrive in two runs, late ones and a replayed one among them, with a compaction."""
    root = fresh_path(spark, "pool")
    week = F.trunc("o_orderdate", "week").cast("date")
    orders = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Campaign ID"), week.alias("served_date"))
    rows = S.restated(spark, sf).join(orders, "Campaign ID")
    keys = ["served_date", "Campaign ID", "Strategy Name"]

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run(store):
        T1.incremental_pool(spark, rows.schema, f"{root}/in", store, f"{root}/checkpoint", keys,
                            VERSION, files_per_batch=1, files_per_day=2)

    quarter = [rows.filter(F.col("version_2") % 4 == i) for i in range(4)]
    arrive(quarter[3])
    arrive(quarter[1])
    run(f"{root}/store")
    T1.compact_store(spark, f"{root}/store", f"{root}/compacted", rows.schema, keys)
    arrive(quarter[0].unionByName(quarter[2]))
    arrive(quarter[3])
    run(f"{root}/compacted")
    T1.prune_store(spark, f"{root}/compacted", rows.schema)
    pooled = T1.pooled_rows(spark, f"{root}/compacted", rows.schema)
    return _pooled(pooled, "served_date")


@query("incremental_creative_alerts", "SELECT section, position, count, text FROM alert_rows")
def incremental_creative_alerts(spark, sf):
    """The feed arrives in three exports whose days overlap, each written and read by all tasks."""
    root = fresh_path(spark, "alerts")
    feed = facts.creative(spark, sf)
    for i in range(3):
        feed.filter(F.col("campaign_id").cast("bigint") % 3 == i).write.mode("append").parquet(
            f"{root}/in")
        T1.incremental_creative_alerts(
            spark, feed.schema, f"{root}/in", f"{root}/state", f"{root}/out",
            f"{root}/checkpoint")
    return T1.latest_alert(spark, f"{root}/out")
