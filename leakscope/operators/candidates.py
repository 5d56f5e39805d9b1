"""Placements worth blocking: review candidates, automatic app and site blocks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions import names as N
from leakscope.functions.ratios import ctr, money, ratio, total
from leakscope.functions.text import fixed, fold, grouped, percent, strip, text_in
from leakscope.operators.leak import delivering, flagged_block_names
from leakscope.operators.norms import sums, with_norm
from leakscope.sources.dimensions import since_column

BLOCK_COLUMNS = [
    "name", "app_id", "products", "impressions", "clicks", "ctr", "spend", "conversions",
    "ttddv", "raw_value", "category", "reason",
]


def _flag(product: str) -> str:
    return "_on_" + product.lower().replace(" ", "_")


def _covered(products=K.PLACEMENT_PRODUCTS):
    """Every known product a placement ran on is blocked by a tab it is listed on.

    Products are a fixed set, so 'for all' is a conjunction of columns, not an exploded join. A
    listed placement without known products counts as covered.
    """
    everywhere = F.col(since_column(K.TAB_ALL)).isNotNull()
    ok = F.lit(True)
    for p in products:
        tab = K.PRODUCT_TABS.get(p)
        blocked = everywhere | F.col(since_column(tab)).isNotNull() if tab else everywhere
        ok = ok & (~F.col(_flag(p)) | blocked)
    return F.col("_key").isNotNull() & ok


def block_candidates(delivery: DataFrame, kind: str, blocklist: DataFrame | None = None):
    """Delivering placements of a kind that are neither flagged nor covered by the block list.

    Apps are keyed by id, since unrelated apps share display names. Rows are first summed per
    spelling with hash aggregates; the text minimum and maximum per key run over those groups.
    """
    own_id = F.when(~text_in(F.col("app_id"), K.BLANK_NAMES), strip(F.col("app_id")))
    key = F.coalesce(own_id, F.col("placement")) if kind == "app" else F.col("placement")
    rows = delivering(delivery).filter(
        (F.col("placement_type") == kind) & ~F.col("is_block") & key.isNotNull()
    )
    per = rows.groupBy(
        key.alias("key"), "placement", "app_id", "raw_value", "product"
    ).agg(
        *sums("impressions", "clicks", "conversions", "spend"),
        F.bool_or(N.is_combined_dsp(F.col("dsp"))).alias("ttddv"),
    )
    on = [
        F.coalesce(F.bool_or(F.col("product") == p), F.lit(False)).alias(_flag(p))
        for p in K.PLACEMENT_PRODUCTS
    ]
    g = per.groupBy("key").agg(
        F.min("placement").alias("name"), F.min("app_id").alias("app_id"),
        N.known_products(F.col("product")).alias("products"),
        *sums("impressions", "clicks", "conversions", "spend"),
        F.bool_or("ttddv").alias("ttddv"), F.max("raw_value").alias("raw_value"), *on,
    )
    flagged = flagged_block_names(delivery).filter(F.col("placement_type") == kind)
    g = g.join(flagged.select(F.col("placement").alias("name")), "name", "left_anti")
    if blocklist is not None:
        since = [c for c in blocklist.columns if c.startswith("since_")]
        listed = blocklist.select(F.col("match_key").alias("_key"), *since)
        mine = fold(F.col("app_id" if kind == "app" else "name"))
        g = g.join(listed, mine == F.col("_key"), "left").filter(~_covered())
    return g.select(
        "name", "app_id", "products", "impressions", "clicks", "conversions",
        money("spend").alias("spend"), "ttddv", "raw_value",
    )


def _with_family(
    candidates: DataFrame, min_developers: int, family_min_impr: int, member_min_impr: int
) -> DataFrame:
    """Add developers and impressions of the clone family a candidate belongs to, else null.

    A family is a display name that several developers ship. Its totals come from an aggregate
    that is joined back, so a family of any size is never held in one task.
    """
    marked = candidates.withColumns(
        {
            "family": N.family_name(F.col("name")),
            "_developer": F.when(
                ~N.is_streaming_platform(F.col("name")), N.developer_prefix(F.col("app_id"))
            ),
        }
    )
    eligible = marked.filter(F.col("_developer").isNotNull() & (F.col("family") != ""))
    families = (
        eligible.groupBy("family", "_developer").agg(total("impressions"))
        .groupBy("family").agg(
            F.count("*").alias("developers"), total("impressions", "family_impressions")
        )
        .filter((F.col("developers") >= min_developers)
                & (F.col("family_impressions") >= family_min_impr))
    )
    member = F.col("_developer").isNotNull() & (F.col("impressions") >= member_min_impr)
    out = marked.join(families, "family", "left")
    return out.withColumns(
        {c: F.when(member, F.col(c)) for c in ("developers", "family_impressions")}
    ).drop("_developer")


def clone_families(
    app_candidates: DataFrame, min_developers: int = 3, family_min_impr: int = 2500,
    member_min_impr: int = 100,
) -> DataFrame:
    """Apps of families in which several developers ship one display name."""
    return _with_family(
        app_candidates, min_developers, family_min_impr, member_min_impr
    ).filter(F.col("developers").isNotNull()).select(
        "family", "app_id", "name", "impressions", "developers", "family_impressions"
    )


def auto_app_blocks(
    app_candidates: DataFrame, min_developers: int = 3, family_min_impr: int = 2500,
    member_min_impr: int = 100,
) -> DataFrame:
    """Apps to block by rule: unresolved bundle, gaming or junk name, else clone family."""
    df = _with_family(app_candidates, min_developers, family_min_impr, member_min_impr)
    junk = N.app_junk_category(F.col("name"))
    clone = F.concat(
        F.col("developers").cast("string"),
        F.lit(" different developers ship apps under this name ("),
        grouped(F.col("family_impressions")),
        F.lit(" family impressions) — clone-farm inventory"),
    )
    judged = df.withColumn("_junk", junk).withColumns(
        {
            "category": F.coalesce(
                F.col("_junk"), F.when(F.col("developers").isNotNull(), F.lit(K.CLONE_CATEGORY))
            ),
            "reason": F.coalesce(N.app_junk_reason(F.col("_junk")), clone),
            "ctr": ctr(),
        }
    )
    return judged.filter(F.col("category").isNotNull()).select(*BLOCK_COLUMNS)


def click_sites(delivery: DataFrame) -> DataFrame:
    """Site delivery on products on which clicks are expected."""
    product = strip(F.col("product"))
    return delivering(delivery).filter(F.col("placement_type") == "site").withColumn(
        "product", product
    ).filter(
        ~F.col("product").isin(*K.NO_CLICK_PLACEMENT_PRODUCTS)
        & ~text_in(F.col("product"), K.BLANK_DIMENSIONS)
    )


def _site_groups(site: DataFrame) -> DataFrame:
    """Sums per site, product and raw value: hash aggregates only, one short row per spelling."""
    return site.groupBy("placement", "product", "raw_value").agg(
        *sums("impressions", "clicks", "conversions", "spend"),
        F.bool_or(N.is_combined_dsp(F.col("dsp"))).alias("ttddv"),
    )


def low_ctr_sites_by_client(
    delivery: DataFrame, min_impr: int = 5000, ctr_multiple: float = 3.0,
    ctr_floor: float = 0.0007, conv_rate_keep: float = 0.0003,
) -> DataFrame:
    """Client x site rows far below the product's rate and below a floor, unless they convert."""
    keys = ["business_unit", "client", "product", "site"]
    site = click_sites(delivery)
    g = site.withColumnRenamed("placement", "site").groupBy(*keys).agg(
        *sums("impressions", "clicks", "conversions", "spend")
    ).withColumns({"spend": money("spend"), "ctr": ctr()})
    g = with_norm(g, site, "product", "product_ctr").withColumn(
        "conv_rate", ratio("conversions", "impressions")
    )
    flagged = g.filter(
        (F.col("impressions") >= min_impr) & (F.col("product_ctr") > 0)
        & (F.col("x_over_norm") <= 1.0 / ctr_multiple) & (F.col("ctr") <= ctr_floor)
        & (F.col("conv_rate") < conv_rate_keep)
    )
    reason = F.concat(
        F.lit("CTR "), percent(F.col("ctr"), 3), F.lit(" is "), fixed(F.col("x_over_norm"), 2),
        F.lit("× the "), F.col("product"), F.lit(" norm ("), percent(F.col("product_ctr"), 3),
        F.lit(f") and below the {ctr_floor * 100:.2f}% floor"),
    )
    return flagged.select(
        *keys, "impressions", "clicks", "conversions", "spend", "ctr", "product_ctr",
        "x_over_norm", "conv_rate", reason.alias("reason"),
    )


def handled_site_keys(delivery: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Keys of sites that are flagged already or on the block list."""
    flagged = flagged_block_names(delivery).filter(F.col("placement_type") == "site")
    keys = flagged.select(fold(F.col("placement")).alias("_handled"))
    if blocklist is not None:
        keys = keys.unionByName(blocklist.select(F.col("match_key").alias("_handled")))
    return keys.distinct()


def _without(df: DataFrame, handled: DataFrame | None) -> DataFrame:
    if handled is None:
        return df
    return df.join(handled, fold(df["name"]) == handled["_handled"], "left_anti")


def auto_low_ctr_site_blocks(
    delivery: DataFrame, handled: DataFrame | None = None, min_impr: int = 10000,
    ctr_floor: float = 0.0007, conv_rate_keep: float = 0.0003,
) -> DataFrame:
    """Sites with volume, hardly any clicks and hardly any conversions over all clients.

    Rows are summed per site and product first: the product list of a site is then built from
    one entry per product, and the site totals from those few groups.
    """
    g = _site_groups(click_sites(delivery)).groupBy(F.col("placement").alias("name")).agg(
        N.known_products(F.col("product")).alias("products"),
        *sums("impressions", "clicks", "conversions", "spend"),
        F.bool_or("ttddv").alias("ttddv"), F.max("raw_value").alias("raw_value"),
    ).withColumns({"spend": money("spend"), "ctr": ctr()})
    flagged = g.filter(
        (F.col("impressions") >= min_impr) & (F.col("ctr") <= ctr_floor)
        & (ratio("conversions", "impressions") < conv_rate_keep)
        & ~text_in(F.col("name"), K.BLANK_NAMES)
    )
    reason = F.concat(
        F.lit("CTR "), percent(F.col("ctr"), 3), F.lit(" with "),
        F.col("conversions").cast("string"), F.lit(" conversions across "),
        grouped(F.col("impressions")), F.lit(" impressions (all clients)"),
    )
    return _without(flagged, handled).select(
        "name", F.col("name").alias("app_id"), "products", "impressions", "clicks", "ctr",
        "spend", "conversions", "ttddv", "raw_value",
        F.lit(K.LOW_CTR_CATEGORY).alias("category"), reason.alias("reason"),
    )


def low_ctr_site_products(delivery: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every product a flagged site ran on: one row for each site and product.

    `products` of the flags names known products only; `other_products` counts a site's others.
    """
    per = _site_groups(click_sites(delivery)).groupBy(
        F.col("placement").alias("name"), "product").agg(
        *sums("impressions", "clicks", "conversions", "spend"),
    ).withColumn("is_known", F.col("product").isin(*K.PLACEMENT_PRODUCTS))
    of_flagged = per.join(flagged.select("name"), "name")
    # partial sums in the map tasks, so a site with very many product values is no single task
    others = of_flagged.groupBy(F.col("name").alias("_site")).agg(
        F.count_if(~F.col("is_known")).alias("other_products"))
    return of_flagged.join(others, F.col("name") == F.col("_site")).select(
        "name", "product", "is_known", "impressions", "clicks", "conversions",
        money("spend").alias("spend"), "other_products")


def auto_high_ctr_site_blocks(
    delivery: DataFrame, handled: DataFrame | None = None, min_impr: int = 10000,
    ctr_multiple: float = 3.0, ctr_floor: float = 0.01,
) -> DataFrame:
    """Sites whose click rate is abnormal for a product; the most extreme product counts."""
    site = click_sites(delivery)
    per = _site_groups(site).groupBy("placement", "product").agg(
        *sums("impressions", "clicks", "conversions", "spend"),
        F.bool_or("ttddv").alias("ttddv"), F.max("raw_value").alias("raw_value"),
    ).withColumns({"spend": money("spend"), "ctr": ctr()})
    flagged = with_norm(per, site, "product", "product_ctr").filter(
        (F.col("impressions") >= min_impr) & (F.col("ctr") >= ctr_floor)
        & (F.col("product_ctr") > 0) & (F.col("x_over_norm") >= ctr_multiple)
        & ~text_in(F.col("placement"), K.BLANK_NAMES)
    ).withColumnRenamed("placement", "name")
    # rank 1 of a window is cut per map task before the shuffle
    extreme = Window.partitionBy("name").orderBy(F.desc("x_over_norm"), "product")
    first = _without(flagged, handled).withColumn("_n", F.row_number().over(extreme)).filter(
        "_n = 1"
    )
    reason = F.concat(
        F.lit("CTR "), percent(F.col("ctr"), 2), F.lit(" is "), fixed(F.col("x_over_norm"), 1),
        F.lit("× the "), F.col("product"),
        F.lit(" norm — abnormally HIGH (possible invalid traffic)"),
    )
    return first.select(
        "name", F.col("name").alias("app_id"), F.col("product").alias("products"),
        "impressions", "clicks", "ctr", "spend", "conversions", "ttddv", "raw_value",
        F.lit(K.HIGH_CTR_CATEGORY).alias("category"), reason.alias("reason"),
    )
