"""Creative performance: outliers against the product's rate, fatigue, rotation, reuse.

All tables look at named creatives only: an unnamed one can be neither judged nor changed.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.ratios import cpm, ctr, money, ratio, total
from leakscope.functions.text import date_or, text_in
from leakscope.operators.creative_quality import named, present
from leakscope.operators.norms import one_row_total, sums, with_norm
from leakscope.operators.ranking import numbered

ROSTER_KEYS = [
    "client", "business_unit", "product", "campaign", "campaign_id", "creative_id", "creative",
]
ROTATION_KEYS = ["client", "product", "campaign", "campaign_id"]


def clickable(product: Column | str = "product") -> Column:
    product = F.col(product) if isinstance(product, str) else product
    return ~text_in(product, K.NO_CLICK_CREATIVE_PRODUCTS)


def creative_roster(creative: DataFrame) -> DataFrame:
    """One row per named creative and campaign."""
    keys = present(creative, ROSTER_KEYS)
    g = named(creative).groupBy(*keys).agg(
        *sums("impressions", "clicks", "spend", "conversions"), F.count("*").alias("rows"),
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.countDistinct("date").alias("days"),
    ).withColumn("spend", money("spend"))
    return g.select(
        *keys, "impressions", "clicks", "spend", "conversions", "rows",
        date_or(F.col("first"), "NaT").alias("first_seen"),
        date_or(F.col("last"), "NaT").alias("last_seen"), "days",
        ctr().alias("ctr"), cpm().alias("cpm"),
        ratio("spend", "conversions", None).alias("cost_per_conv"),
    )


def product_norms(creative: DataFrame) -> DataFrame:
    """Pooled rates of the known products, leaked product values left out."""
    known = named(creative).filter(text_in(F.col("product"), K.CREATIVE_PRODUCTS))
    return known.groupBy("product").agg(
        ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"), total("impressions")
    )


def rated_roster(creative: DataFrame) -> DataFrame:
    """The roster with its product's rate and the multiple of it."""
    rated = with_norm(creative_roster(creative), named(creative), "product", "product_ctr")
    return rated.withColumn("product_ctr", F.coalesce("product_ctr", F.lit(0.0)))


def creative_winners(
    creative: DataFrame, min_impr: int = 10000, multiple: float = 3.0, verify: float = 10.0
) -> DataFrame:
    big = rated_roster(creative).filter(clickable() & (F.col("impressions") >= min_impr))
    read = F.when(
        F.col("x_over_norm") >= verify, "verify — implausibly high, check for invalid traffic"
    ).otherwise("outperformer — worth scaling / reusing")
    return big.filter((F.col("x_over_norm") >= multiple) & (F.col("clicks") > 0)).withColumn(
        "read", read
    )


def creative_laggards(creative: DataFrame, min_impr: int = 10000, share: float = 1 / 3.0):
    """At most a third of the product's rate; a product without clicks makes all of its own."""
    return rated_roster(creative).filter(
        clickable() & (F.col("impressions") >= min_impr) & (F.col("x_over_norm") <= share)
    )


def creative_zero_click(creative: DataFrame, min_impr: int = 5000) -> DataFrame:
    return creative_roster(creative).filter(
        clickable() & (F.col("clicks") == 0) & (F.col("impressions") >= min_impr)
    )


def creative_zero_conversion(creative: DataFrame, min_spend: float = 50.0) -> DataFrame:
    return creative_roster(creative).filter(
        (F.col("conversions") == 0) & (F.col("spend") >= min_spend)
    )


def creative_fatigue(
    creative: DataFrame, min_impr: int = 5000, drop: float = 0.40, min_days: int = 3
) -> DataFrame:
    """Creatives whose rate fell between the first and the second half of the window.

    The window's ends are one scalar subquery; both halves are conditional sums of one
    aggregate. Rows without a date count to the late half.
    """
    rows = named(creative)
    ends = one_row_total(rows, lo=F.min("date"), hi=F.max("date"))
    span = F.datediff(ends["hi"], ends["lo"])
    early = F.coalesce(F.datediff(F.col("date"), ends["lo"]) * 2 <= span, F.lit(False))
    keys = present(creative, ["client", "product", "campaign_id", "creative"])

    def half(c, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    g = rows.withColumn("_early", early).groupBy(*keys).agg(
        half("impressions", F.col("_early")).alias("i_a"),
        half("impressions", ~F.col("_early")).alias("i_b"),
        half("clicks", F.col("_early")).alias("c_a"),
        half("clicks", ~F.col("_early")).alias("c_b"),
        money(total(F.col("spend"))).alias("spend"),
    ).filter((F.col("i_a") >= min_impr) & (F.col("i_b") >= min_impr) & (span >= min_days))
    g = g.withColumns(
        {"ctr_early": ctr("c_a", "i_a"), "ctr_late": ctr("c_b", "i_b"),
         "impressions": F.col("i_a") + F.col("i_b")}
    ).withColumn(
        "drop",
        F.when(F.col("ctr_early") > 0, 1 - F.col("ctr_late") / F.col("ctr_early")).otherwise(0.0),
    )
    return g.filter((F.col("ctr_early") > 0) & (F.col("drop") >= drop) & clickable()).select(
        *keys, "impressions", "spend", "ctr_early", "ctr_late", "drop"
    )


def _campaigns(creative: DataFrame) -> DataFrame:
    keys = present(creative, ROTATION_KEYS)
    per = named(creative).groupBy(*keys, "creative").agg(*sums("impressions", "clicks", "spend"))
    return per.groupBy(*keys).agg(
        F.count("creative").alias("creatives"), *sums("impressions", "clicks", "spend")
    )


def single_creative_campaigns(creative: DataFrame, min_impr: int = 10000) -> DataFrame:
    alone = _campaigns(creative).filter(
        (F.col("creatives") == 1) & (F.col("impressions") >= min_impr)
    )
    return alone.withColumns({"spend": money("spend"), "ctr": ctr()})


def dominant_creatives(
    creative: DataFrame, min_impr: int = 10000, min_creatives: int = 3, min_share: float = 0.8
) -> DataFrame:
    """Creatives that carry most of a campaign that has several. Null keys join as equal."""
    keys = present(creative, ROTATION_KEYS)
    multi = _campaigns(creative).filter(
        (F.col("creatives") >= min_creatives) & (F.col("impressions") >= min_impr)
    ).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("impressions").alias("campaign_impressions"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = creative_roster(creative).join(multi, same).drop(*[f"_{k}" for k in keys])
    return joined.withColumn("share", ratio("impressions", "campaign_impressions")).filter(
        F.col("share") >= min_share
    )


def duplicate_names(creative: DataFrame) -> DataFrame:
    """Creative names that several clients use."""
    per = named(creative).groupBy("creative", "client", "campaign_id").agg(
        *sums("impressions", "spend")
    )
    g = per.groupBy("creative").agg(
        F.countDistinct("client").alias("clients"),
        F.countDistinct("campaign_id").alias("campaigns"),
        total("impressions"), money(total(F.col("spend"))).alias("spend"),
    )
    return g.filter(F.col("clients") > 1)


def top_creatives(creative: DataFrame) -> DataFrame:
    """The whole roster with each row's rank by impressions; ties go by the roster's keys."""
    roster = creative_roster(creative)
    order = [F.desc("impressions"), *[F.col(k) for k in present(creative, ROSTER_KEYS)]]
    ranked = numbered(roster.withColumn("_all", F.lit(0)), ["_all"], order, "rank")
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_all")
