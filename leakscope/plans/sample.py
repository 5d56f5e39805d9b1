"""The audit's facts and dimensions, derived from the star-schema sample tables.

Each fact is a lazy view. A caller names the columns it reads, and only the dimension tables
those columns come from are joined.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = {
    "ECONOMY": "Display", "STANDARD": "Social Mirror", "MEDIUM": "Video", "LARGE": "CTV",
    "SMALL": "Native Display", "PROMO": "Online Audio",
}
CREATIVE_PRODUCTS = [
    "Display", "Social Mirror", "Video", "CTV", "Native Display", "Online Audio",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The line items."""
    df = table(spark, sf, "lineitem")
    return df.select(*columns) if columns else df


def _long(c) -> Column:
    return F.col(c).cast("bigint")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _pick(c: Column, mapping: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for key, value in mapping.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def _delivery_columns() -> dict[str, tuple[str, Column]]:
    """Column -> (dimension tables it needs, expression over the joined row)."""
    site = F.col("l_linenumber") <= 4
    lane = F.col("l_suppkey") % 10
    ppm = (
        F.when(lane == 0, 40000).when(lane == 1, 100).when(F.col("p_type") == "LARGE", 300)
        .otherwise(3000)
    )
    conversions = F.when(
        (F.col("l_returnflag") == "R") & (lane != 1), F.col("l_linenumber")
    ).otherwise(0).cast("bigint")
    block = (F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 4 == 1)
    placement = F.when(site, F.col("s_name")).otherwise(F.col("_app_name"))
    return {
        "served_date": ("", F.col("l_shipdate").cast("date")),
        "business_unit": ("ocn", F.col("n_name")),
        "client": ("oc", F.col("c_name")),
        "product": ("p", _pick(F.col("p_type"), PRODUCTS)),
        "strategy_type": ("o", F.col("o_orderpriority")),
        "strategy_name": (
            "oc", F.concat(F.col("o_orderpriority"), F.lit(" / "), F.col("c_mktsegment"))),
        "campaign_id": ("", F.col("l_orderkey").cast("string")),
        "placement_type": ("", F.when(site, "site").otherwise("app")),
        "placement": ("sp", placement),
        "app_id": ("sp", F.when(site, F.col("s_name")).otherwise(F.col("_bundle"))),
        "dsp": ("", F.when(F.col("l_suppkey") % 5 == 2, "TTD/DV360").otherwise("direct")),
        "raw_value": ("sp", F.when(site, F.col("s_name")).otherwise(
            F.concat(F.col("_app_name"), F.lit(" ("), F.col("_bundle"), F.lit(")")))),
        "impressions": ("", F.col("_impr")),
        "clicks": ("p", _div(F.col("_impr") * ppm, 1000000)),
        "conversions": ("", conversions),
        "view_throughs": ("", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("bigint")),
        "spend": ("", F.col("l_extendedprice").cast("decimal(18,2)")),
        "final": ("sp", F.when(block, F.lit("Block")).otherwise(placement)),
        "is_block": ("", block),
        "is_unresolved": ("", F.lit(False)),
        "has_conversions": ("", F.lit(True)),
        "exchange": ("", F.concat(F.lit("EX-"), lane.cast("string"))),
    }


def _bundle() -> Column:
    return F.concat(
        F.lit("com.brand"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".app"),
        F.col("p_partkey").cast("string"))


def _part_names(part: DataFrame) -> DataFrame:
    """Parts with their app name and bundle id, worked out once per part."""
    name = F.replace(
        F.replace("p_name", F.lit("gizmo"), F.lit("puzzle game")), F.lit("bolt"),
        F.lit("flashlight"))
    return part.select(
        "p_partkey", "p_type", name.alias("_part_name"), _bundle().alias("_bundle"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("_brand"))


def _line_values(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The line items with days and amounts in their short forms, which are what gets shuffled."""
    return lines(spark, sf, *columns).withColumns({
        "l_shipdate": F.col("l_shipdate").cast("date"),
        "l_extendedprice": F.col("l_extendedprice").cast("decimal(18,2)")})


def _order_texts(spark: SparkSession, sf: str, customers: bool) -> DataFrame:
    """Orders with their priority and, if asked for, their customer's texts."""
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    if not customers:
        return order.drop("o_custkey")
    customer = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return order.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop(
        "o_custkey", "c_custkey")


def delivery(
    spark: SparkSession, sf: str, *columns: str, clustered: bool = False
) -> DataFrame:
    """Site and app delivery at line grain. Column pruning decides the scan's columns.

    Customers join the orders, not the lines, and names of parts, suppliers and nations join last:
    a line is shuffled at most twice, without the texts that are built from them. `clustered` rows
    are rebalanced by part, so that rows of one app meet in one partition, which the join with the
    parts then uses as well.
    """
    defined = _delivery_columns()
    columns = columns or tuple(defined)
    need = {t for c in columns for t in defined[c][0]}
    df = _line_values(
        spark, sf, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    if "o" in need:
        orders = _order_texts(spark, sf, "c" in need)
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    if clustered:
        df = df.hint("rebalance", F.col("l_partkey"))
    if "p" in need:
        parts = _part_names(table(spark, sf, "part"))
        # Names under which flagged rows occur, so that not every app name is a flagged one.
        pro = F.when(F.col("l_suppkey") % 4 == 1, " pro").otherwise("")
        df = df.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn(
            "_app_name", F.concat("_part_name", pro))
    if "s" in need:
        df = df.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "n" in need:
        df = df.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.withColumn("_impr", _long("l_quantity") * 1000)
    return df.select(*[defined[c][1].alias(c) for c in columns])


def placement_columns() -> list[str]:
    """The columns of delivery that need no order."""
    return [c for c, (needed, _) in _delivery_columns().items() if "o" not in needed]


def blocklist_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(value, tab, date_added): some suppliers per tab, and some parts as app ids."""
    key = F.col("s_suppkey")
    tab = _pick(key % 4, {0: "All Products", 1: "CTV", 2: "Social Mirror", 3: "Audio"})
    day = F.when(key % 3 != 0, F.when(key % 7 == 0, F.lit("2002-06-01").cast("date")).otherwise(
        F.date_add(F.lit("1998-01-01").cast("date"), key.cast("int"))))
    sites = table(spark, sf, "supplier").filter(
        (key % 2 == 0) | (key % 4 == 1) | (key % 8 == 3)).select(
        F.col("s_name").alias("value"), tab.alias("tab"), day.alias("date_added"))
    bundle = F.concat(
        F.lit("com.brand"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".app"),
        F.col("p_partkey").cast("string"))
    apps = table(spark, sf, "part").filter(F.col("p_partkey") % 50 == 0).select(
        bundle.alias("value"), F.lit("All Products").alias("tab"),
        F.lit("1999-01-01").cast("date").alias("date_added"))
    return sites.unionByName(apps)


def audio_blocklist_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the Audio tab, from suppliers that are on no other tab."""
    key = F.col("s_suppkey")
    day = F.when(key % 3 != 0, F.when(key % 7 == 0, F.lit("2002-06-01").cast("date")).otherwise(
        F.date_add(F.lit("1998-01-01").cast("date"), key.cast("int"))))
    return table(spark, sf, "supplier").filter(key % 4 == 3).select(
        F.col("s_name").alias("value"), F.lit("Audio").alias("tab"), day.alias("date_added"))


def broken_blocklist_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Block rows with spelling faults: composites, 'www.' forms, blanks, and good ones."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    value = (
        F.when(key % 4 == 0, F.concat(F.lit("Old name ("), name, F.lit(".com)")))
        .when(key % 4 == 1, F.concat(F.lit("www."), name))
        .when(key % 4 == 2, F.replace(name, F.lit("#"), F.lit(" #")))
        .otherwise(name)
    )
    return table(spark, sf, "supplier").select(
        value.alias("value"), F.lit("CTV").alias("tab"), F.lit(None).cast("date").alias("date_added"))


def site_export(spark: SparkSession, sf: str) -> DataFrame:
    """Raw site export: report headers, text-typed numbers and a column nobody uses."""
    return _export(spark, sf, "site").select(
        "Client Business Unit", "date", "client", "PRODUCT 2", "Strategy Type", "strategy_name",
        "Campaign Id", F.col("placement").alias("Site Domain"),
        F.col("final").alias("final_site_domain_name"), "impressions", "CLICKS",
        "post_click_conversions", "Post View Conversions", "billable_spend", "Margin", "dsp",
    )


def app_export(spark: SparkSession, sf: str) -> DataFrame:
    """Raw app export with composite ids ('Name (bundle.id)')."""
    return _export(spark, sf, "app").select(
        "Client Business Unit", "date", "client", "PRODUCT 2", "Strategy Type", "strategy_name",
        "Campaign Id", F.col("placement").alias("app_name"),
        F.col("final").alias("final_app_name_use_me"), F.col("raw_value").alias("App ID"),
        "impressions", "CLICKS", "post_click_conversions", "Post View Conversions",
        "billable_spend", "Margin", "dsp",
    )


def _export(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = delivery(
        spark, sf, "business_unit", "served_date", "client", "product", "strategy_type",
        "strategy_name", "campaign_id", "placement", "final", "raw_value", "impressions",
        "clicks", "conversions", "view_throughs", "spend", "dsp", "placement_type",
    ).filter(F.col("placement_type") == kind)
    names = {
        "business_unit": "Client Business Unit", "served_date": "date", "product": "PRODUCT 2",
        "strategy_type": "Strategy Type", "campaign_id": "Campaign Id", "clicks": "CLICKS",
        "conversions": "post_click_conversions", "view_throughs": "Post View Conversions",
        "spend": "billable_spend",
    }
    return rows.withColumnsRenamed(names).withColumn("Margin", F.col("impressions") * 2)


def combined_export(spark: SparkSession, sf: str) -> DataFrame:
    """One App/URL export: domains, composites, store ids and bundles; some rows state a type."""
    rows = delivery(spark, sf, "placement_type", "placement", "app_id", "raw_value",
                    "impressions", "campaign_id", "client", "spend")
    n = F.col("campaign_id").cast("bigint")
    domain = F.concat(F.lower(F.regexp_replace("placement", "#", "")), F.lit(".com"))
    value = F.when(F.col("placement_type") == "site", domain).when(
        n % 4 == 0, F.concat(F.lit("id"), (n + 1000000).cast("string"))
    ).when(n % 4 == 1, F.col("app_id")).when(n % 4 == 2, F.lit("cdn.desktop.aol.com")).otherwise(
        F.col("raw_value"))
    stated = F.when(n % 10 == 3, "Web site").when(n % 10 == 4, "In-app").otherwise("")
    return rows.select(
        value.alias("App/URL"), stated.alias("Site/App"), F.col("campaign_id").alias("Campaign ID"),
        F.col("client").alias("Client"), F.col("impressions").alias("Impressions"),
        F.col("spend").alias("Billable Spend"))


def restated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several exports that restate the same key; version columns tell which is newer."""
    return lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("Campaign ID"),
        F.col("l_linenumber").cast("string").alias("Strategy Name"),
        F.col("l_shipdate").cast("date").alias("file_date"), F.col("l_partkey").alias("version_1"),
        F.col("l_suppkey").alias("version_2"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("Billable Spend"),
        (_long("l_quantity") * 1000).alias("Impressions"))


def restated_creatives(spark: SparkSession, sf: str) -> DataFrame:
    """As `restated` at creative grain, with creative names that are null."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string")).when(
        F.col("p_partkey") % 5 == 1, F.lit(" ")).otherwise(F.col("p_name"))
    df = lines(spark, sf).join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.select(
        name.alias("Creative Name"), (F.col("l_suppkey") % 50).cast("string").alias("Campaign ID"),
        F.concat(F.lit("https://x.example.com/"), F.col("l_orderkey").cast("string"))
        .alias("Clickthrough URL"),
        F.col("l_shipdate").cast("date").alias("file_date"), F.col("l_orderkey").alias("version_1"),
        F.col("l_linenumber").alias("version_2"), F.col("l_partkey").alias("version_3"),
        F.col("l_suppkey").alias("version_4"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("Billable Spend"),
        (_long("l_quantity") * 1000).alias("Impressions"))


def overview_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Overview rows as a workbook gives them: text numbers, and summary rows to drop."""
    order = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    unit = F.when(key % 100 == 0, " Total ").when(key % 101 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("BU-"), (key % 7).cast("string")))
    return order.select(
        unit.cast("string").alias("Business Unit"), key.cast("string").alias("Client"),
        F.when(key % 10 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
        .alias("Impressions"),
        F.when(key % 10 == 1, F.lit(None)).otherwise((key % 13).cast("string")).alias("Clicks"))


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Excluded sites as URL variants, and some excluded app ids."""
    sites = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 13 == 0).select(
        F.concat(F.lit("https://www."), F.col("s_name"), F.lit("/x")).alias("value"))
    apps = table(spark, sf, "part").filter(F.col("p_partkey") % 13 == 0).select(
        F.concat(F.lit("com.brand"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".app"),
                 F.col("p_partkey").cast("string")).alias("value"))
    return sites.unionByName(apps)


def buyer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Partner to buyer; every fifth partner is spelled in lower case with outer blanks."""
    odd = F.col("n_nationkey") % 5 == 0
    partner = F.when(odd, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).otherwise(
        F.col("n_name"))
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), partner.alias("Partner"), F.col("r_name").alias("Buyer"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts (kind, batch, line) of a reviewer: parts point at every seventh line."""
    slot = (F.col("p_partkey") * 7) % 400
    lines = table(spark, sf, "part").select(
        F.when(slot < 200, "site").otherwise("app").alias("kind"),
        F.floor(slot % 200 / 50).cast("int").alias("batch"),
        (slot % 50 + 1).cast("int").alias("line"),
    ).filter(F.col("line") % 7 == 0).distinct()
    return lines.select(
        "*", F.when(F.col("line") % 2 == 0, "MFA").otherwise("Brand safety").alias("category"),
        F.concat(F.lit("line "), F.col("line").cast("string")).alias("reason"))


def _creative_columns() -> dict[str, Column]:
    supp, cb, impressions = F.col("l_suppkey"), F.col("_cb"), F.col("_impr")
    text = cb.cast("string")
    suffix = _pick(cb % 6, {0: "300x250", 1: "1080x1080", 2: "728x90", 3: "v2.mp4",
                            4: "hero.jpg", 5: "spring"})
    name = F.when(cb == 24, F.lit(None).cast("string")).when(cb == 25, "untitled").otherwise(
        F.concat(F.lit("Brand"), text, F.lit(" "), suffix))
    leaked = F.concat(F.lit("Leaked "), supp.cast("string"))
    product = F.coalesce(_pick(supp % 7, dict(enumerate(CREATIVE_PRODUCTS))), leaked)
    base = F.concat(F.lit("https://shop"), text, F.lit(".example.com/"))
    url = (
        F.when(cb % 7 == 0, F.lit(None).cast("string"))
        .when(cb % 7 == 1, F.concat(base, F.lit("?utm_source=a&utm_medium=b&utm_campaign=c")))
        .when(cb % 7 == 2, F.concat(base, F.lit("?utm_source=a")))
        .when(cb % 7 == 3, F.concat(base, F.lit("?gclid=x")))
        .when(cb % 7 == 5, F.concat(base, F.lit("p"), (supp % 2).cast("string")))
        .otherwise(base)
    )
    day = F.col("l_shipdate").cast("date")
    ppm = (
        F.when(cb == 2, 0).when(cb == 5, 30000)
        .when((cb == 8) & (day > F.lit("1998-06-04").cast("date")), 500).otherwise(3000)
    )
    size = F.when(cb % 5 == 0, F.lit("320 x 50")).when(cb % 5 == 1, F.lit("")).otherwise(
        F.lit(None).cast("string"))
    kind = _pick(cb % 4, {0: "video", 1: " banner ", 2: "-"}, "native")
    return {
        "date": (day),
        "business_unit": (F.when(supp % 11 == 0, "").otherwise(
            F.concat(F.lit("BU-"), (F.col("s_nationkey") % 5).cast("string")))),
        "client": (F.col("n_name")),
        "product": (product),
        "strategy_type": (F.col("l_returnflag")),
        "strategy_name": (F.concat("l_returnflag", F.lit("/"), "l_linestatus")),
        "campaign": (F.concat(F.lit("Pool "), supp.cast("string"))),
        "campaign_id": (supp.cast("string")),
        "campaign_pool_id": (F.concat(F.lit("P"), supp.cast("string"))),
        "creative_id": (F.when(cb == 6, "").otherwise(
            F.when(cb == 10, "9").otherwise(text))),
        "creative": (name),
        "creative_size": (size),
        "creative_type": (kind),
        "click_url": (url),
        "preview_url": (F.when(cb % 9 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("https://img.example.com/"), text, F.lit(".png")))),
        "impressions": (impressions),
        "clicks": (F.when((cb == 12) & (F.col("l_quantity") == 1), impressions + 1).otherwise(
            _div(impressions * ppm, 1000000))),
        "conversions": (F.when(
            (F.col("l_returnflag") == "R") & (cb != 11), 1).otherwise(0).cast("bigint")),
        "spend": (F.when(cb == 13, F.lit(0)).otherwise(F.col("l_extendedprice"))
                  .cast("decimal(18,2)")),
        "q25": (_div(impressions * 70, 100)),
        "q50": (_div(impressions * 60, 100)),
        "q75": (_div(impressions * 50, 100)),
        "q100": (_div(impressions * F.when(cb % 2 == 0, 40).otherwise(60), 100)),
    }


def creative(spark: SparkSession, sf: str) -> DataFrame:
    """Creative delivery at line grain, rebalanced by campaign.

    Lines are shuffled before they carry texts; rows of one campaign meet in one partition, so
    sums per creative and campaign are small when they leave the map tasks.
    """
    supp = F.col("l_suppkey")
    values = ("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
              "l_linestatus", "l_shipdate")
    brands = _part_names(table(spark, sf, "part")).select("p_partkey", "_brand")
    df = _line_values(spark, sf, "l_partkey", *values).join(
        brands, F.col("l_partkey") == F.col("p_partkey")).select(*values, "_brand")
    df = df.hint("rebalance", supp)
    df = df.join(table(spark, sf, "supplier"), supp == F.col("s_suppkey"))
    df = df.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = (supp % 20 == 3) | ((supp % 20 == 7) & (F.col("l_linenumber") != 1))
    df = df.withColumns(
        {"_cb": F.when(one, 1).otherwise(F.col("_brand")), "_impr": _long("l_quantity") * 1000})
    return df.select(*[c.alias(name) for name, c in _creative_columns().items()])


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """File manifest with one export per order; some names carry no date or no known kind."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    kind = _pick(key % 6, {0: "site-domains", 1: "apps", 2: "ttddv-siteapp",
                           3: "creative_insights", 4: "notes"}, "Site Domains")
    stamp = F.when(key % 9 == 0, F.lit("latest")).otherwise(F.date_format(F.add_months(day, 120), "yyyyMMdd"))
    ending = F.when(key % 17 == 0, ".txt").otherwise(".csv")
    path = F.concat(
        F.lit("exports/"), kind, F.lit("_"), stamp, F.lit("_n"), key.cast("string"), ending)
    return table(spark, sf, "orders").select(path.alias("path"), day.alias("modified"))
