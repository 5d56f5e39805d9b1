"""The canonical facts of the sample, written once per application and then only scanned.

Around a hundred tables read the same two facts, so each is normalized once: every query after
that is a pruned Parquet scan instead of a chain of dimension joins.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.plans import sample
from leakscope.plans.stage import is_staged, staged


def delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Site and app delivery."""
    return staged(spark, sf, "delivery", lambda: sample.delivery(spark, sf, clustered=True))


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery without the texts of its orders: no partner, client or strategy.

    Where delivery has been written already, those are its columns.
    """
    columns = sample.placement_columns()
    if is_staged(spark, sf, "delivery"):
        return delivery(spark, sf).select(*columns)
    return staged(
        spark, sf, "placements",
        lambda: sample.delivery(spark, sf, *columns, clustered=True))


# What recommendations and flags of partners, clients and strategies are made from.
WATCHED = [
    "business_unit", "client", "product", "strategy_type", "strategy_name", "placement_type",
    "placement", "app_id", "dsp", "raw_value", "impressions", "clicks", "conversions",
    "view_throughs", "spend", "is_block",
]


def watched(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery without its days, campaigns and exchanges, for the watch lists and what they need.

    Where delivery has been written already, those are its columns.
    """
    if is_staged(spark, sf, "delivery"):
        return delivery(spark, sf).select(*WATCHED)
    return staged(
        spark, sf, "watched", lambda: sample.delivery(spark, sf, *WATCHED, clustered=True))


def recommending(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that recommendations are made from, of a fact that has been written if one has."""
    if is_staged(spark, sf, "watched"):
        fact = watched(spark, sf)
    else:
        fact = placements(spark, sf)
    return fact.select(*[c for c in WATCHED if c in sample.placement_columns()])


def performance(spark: SparkSession, sf: str, fact=delivery) -> DataFrame:
    """A fact of delivery under the measure names of the performance tables."""
    return fact(spark, sf).select(
        "business_unit", "client", "product", "strategy_type", "strategy_name", "impressions",
        "clicks", "conversions", "view_throughs", F.col("spend").alias("internal_cost"),
    )


def exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery per exchange."""
    return placements(spark, sf).select(
        "exchange", "product", "impressions", "clicks", "conversions", "spend"
    )


def creative(spark: SparkSession, sf: str) -> DataFrame:
    """Creative delivery."""
    return staged(spark, sf, "creative", lambda: sample.creative(spark, sf))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Export files and when they were modified."""
    return staged(spark, sf, "manifest", lambda: sample.manifest(spark, sf).hint("rebalance"))
