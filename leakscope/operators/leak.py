"""Delivery on placements that are flagged to be blocked, and plain delivery rollups.

Input everywhere: canonical delivery rows (see `sources.exports.normalize_delivery`).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.names import display_name, known_products, match_key
from leakscope.functions.ratios import cpm, ctr, money, ratio, total
from leakscope.functions.text import date_or, text_in
from leakscope.operators.norms import sums

ACTIVE_DAYS = 1
LEAK_DIMENSIONS = ["business_unit", "client", "product", "strategy_type"]


def delivering(delivery: DataFrame) -> DataFrame:
    return delivery.filter(F.col("impressions") > 0)


def leaking(delivery: DataFrame) -> DataFrame:
    return delivering(delivery).filter("is_block")


def window_end(delivery: DataFrame) -> Column:
    """Newest delivery date as a scalar subquery."""
    return delivery.agg(F.max("served_date")).scalar()


def with_key(delivery: DataFrame) -> DataFrame:
    key = match_key(F.col("placement_type"), F.col("app_id"), F.col("placement"))
    return delivery.withColumn("match_key", key)


def leak_by_type(delivery: DataFrame) -> DataFrame:
    per = leaking(delivery).groupBy("placement_type", "placement").agg(
        F.count("*").alias("rows"), *sums("impressions", "spend")
    )
    return per.groupBy("placement_type").agg(
        total("rows"), F.count("placement").alias("placements"), total("impressions"),
        money(total(F.col("spend"))).alias("spend"),
    )


def leak_offenders(delivery: DataFrame) -> DataFrame:
    """Totals per leaking placement and how long ago it last served."""
    g = leaking(delivery).groupBy("placement", "placement_type").agg(
        *sums("impressions", "clicks", "conversions", "spend"),
        F.max("served_date").alias("last"),
    )
    days = F.datediff(window_end(delivery), F.col("last"))
    return g.select(
        "placement", "placement_type", "impressions", "clicks", "conversions",
        money("spend").alias("spend"), date_or(F.col("last"), "(no date)").alias("last_served"),
        ctr().alias("ctr"), days.alias("days_since_last"),
        (days <= ACTIVE_DAYS).alias("still_active"),
    )


def _leak_measures() -> list[Column]:
    return [
        total("impressions", "leaked_impressions"), total("clicks", "leaked_clicks"),
        ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        total("conversions", "leaked_conversions"),
        money(total(F.col("spend"))).alias("leaked_spend"),
    ]


def leak_by(delivery: DataFrame, dim: str) -> DataFrame:
    """Leak per value of one dimension; placements are counted after summing per placement."""
    per = leaking(delivery).groupBy(dim, "placement").agg(
        *sums("impressions", "clicks", "conversions", "spend")
    )
    return per.groupBy(dim).agg(*_leak_measures(), F.count("placement").alias("placements"))


def leak_rollups(delivery: DataFrame) -> DataFrame:
    """All leak rollups in one pass: (dimension, value) rows by grouping sets.

    Rows are summed to the placement level first, so the expansion multiplies groups, not rows.
    """
    per = leaking(delivery).groupBy(*LEAK_DIMENSIONS, "placement").agg(
        *sums("impressions", "clicks", "conversions", "spend")
    )
    dims = [F.col(d) for d in LEAK_DIMENSIONS]
    sets = per.groupingSets([[c] for c in dims], *dims).agg(
        *_leak_measures(), F.countDistinct("placement").alias("placements"),
        *[F.grouping(d).alias(f"_{d}") for d in LEAK_DIMENSIONS],
    )
    name = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in LEAK_DIMENSIONS])
    return sets.select(
        name.alias("dimension"), F.coalesce(*LEAK_DIMENSIONS).alias("value"),
        "leaked_impressions", "leaked_clicks", "ctr", "leaked_conversions", "leaked_spend",
        "placements",
    )


def flagged_block_names(delivery: DataFrame) -> DataFrame:
    """Distinct placements that carry the block flag, per type."""
    flagged = delivery.filter(F.col("is_block") & F.col("placement").isNotNull())
    return flagged.select("placement_type", "placement").distinct()


def leak_summary(delivery: DataFrame) -> DataFrame:
    """One row of leak totals, unresolved delivery and the window.

    Everything is summed per placement first; the two distinct counts then run over groups.
    """
    served = F.col("impressions") > 0
    leak, open_ = F.col("is_block") & served, F.col("is_unresolved") & served

    def part(cond, value):
        return F.sum(F.when(cond, value))

    per = delivery.groupBy("placement", "placement_type").agg(
        F.count_if(leak).alias("leak_rows"),
        part(leak, F.col("impressions")).alias("leak_impr"),
        part(leak, F.col("spend")).alias("leak_spend"),
        F.max(F.when(leak, F.col("served_date"))).alias("leak_last"),
        F.count_if(open_).alias("open_rows"), part(open_, F.col("spend")).alias("open_spend"),
        F.min("served_date").alias("first"), F.max("served_date").alias("last"),
    )
    active = F.datediff(window_end(delivery), F.col("leak_last")) <= ACTIVE_DAYS
    name = F.col("placement")

    return per.agg(
        money(total(F.col("leak_spend"))).alias("leaked_spend"),
        total("leak_impr", "leaked_impressions"),
        F.countDistinct(F.when(F.col("leak_rows") > 0, name)).alias("leaked_placements"),
        total("leak_rows", "leaked_rows"),
        F.countDistinct(F.when(F.col("open_rows") > 0, name)).alias("unresolved_placements"),
        money(total(F.col("open_spend"))).alias("unresolved_spend"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("window_start"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("window_end"),
        F.count_if(active).alias("active_placements"),
        money(F.coalesce(F.sum(F.when(active, F.col("leak_spend"))), F.lit(0)))
        .alias("active_spend"),
        F.max("last").isNotNull().alias("has_dates"),
    )


def top_placements(delivery: DataFrame) -> DataFrame:
    """All placements with serving status and share of all named delivery."""
    named = delivering(delivery).withColumn(
        "name",
        F.when(F.col("placement_type") == "app",
               display_name(F.col("placement"), F.col("app_id"))).otherwise(F.col("placement")),
    ).filter(~text_in(F.col("name"), K.BLANK_NAMES))
    all_impressions = named.agg(F.sum("impressions")).scalar()
    g = named.groupBy("name", "placement_type").agg(
        known_products(F.col("product")).alias("products"),
        *sums("impressions", "clicks", "conversions", "spend"),
        F.max("served_date").alias("last"), F.bool_or("is_block").alias("blocked"),
    )
    days = F.datediff(window_end(delivery), F.col("last"))
    return g.select(
        "name", "placement_type", "products", "impressions", "clicks", "conversions",
        money("spend").alias("spend"), "blocked", ctr().alias("ctr"), cpm().alias("cpm"),
        F.when(days <= ACTIVE_DAYS, "serving").when(days > ACTIVE_DAYS, "stopped").otherwise("—")
        .alias("serving"),
        date_or(F.col("last"), "—").alias("last_served"),
        ratio(F.col("impressions"), all_impressions).alias("pct_impr"),
    )


def delivery_by_placement_product(delivery: DataFrame) -> DataFrame:
    valid = delivering(delivery).filter(F.col("product").isin(*K.PLACEMENT_PRODUCTS))
    g = with_key(valid).groupBy("match_key", "placement_type", "product")
    return g.agg(total("impressions"), money(total(F.col("spend"))).alias("spend"))


def delivery_by_placement_strategy(delivery: DataFrame) -> DataFrame:
    g = with_key(delivering(delivery)).groupBy("match_key", "strategy_type")
    return g.agg(total("impressions"), money(total(F.col("spend"))).alias("spend"))


def watchlist_source(delivery: DataFrame) -> DataFrame:
    keys = ["match_key", "business_unit", "client", "product", "strategy_name"]
    return with_key(delivering(delivery)).groupBy(*keys).agg(*sums("impressions", "clicks"))
