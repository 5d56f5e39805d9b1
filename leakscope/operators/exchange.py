"""Exchange totals and exchanges with abnormal click rates.

Input: rows with exchange, product, impressions, clicks, conversions and spend.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.ratios import ctr, money, ratio
from leakscope.functions.text import fixed, percent
from leakscope.operators.norms import one_row_total, sums, with_norm


def exchange_table(fact: DataFrame) -> DataFrame:
    known = fact.filter(F.col("exchange").isNotNull())
    g = known.groupBy("exchange").agg(*sums("impressions", "clicks", "spend"))
    spend = money("spend")
    all_spend = known.agg(F.sum("spend").cast("double")).scalar()
    return g.select(
        "exchange", "impressions", "clicks", spend.alias("spend"), ctr().alias("ctr"),
        F.when(all_spend != 0, spend / all_spend).otherwise(spend).alias("pct_of_spend"),
    )


def exchange_flags(
    fact: DataFrame, min_spend: float = 150.0, min_impr: int = 30000, ctr_multiple: float = 3.0,
    conv_rate_keep: float = 0.0003, low_min_impr: int = 30000,
) -> DataFrame:
    """Exchange x product rows far above or below the product's rate, unless they convert.

    The low rule has its own volume bound and no spend floor.
    """
    keys = ["exchange", "product"]
    known = fact.dropna(subset=keys)
    g = known.groupBy(*keys).agg(*sums("impressions", "clicks", "spend", "conversions"))
    g = g.withColumns({"spend": money("spend"), "ctr": ctr()})
    g = with_norm(g, known, "product", "product_ctr").withColumn(
        "conv_rate", ratio("conversions", "impressions")
    )
    idle = F.col("conv_rate") < conv_rate_keep
    high = (
        (F.col("spend") >= min_spend) & (F.col("impressions") >= min_impr)
        & (F.col("x_over_norm") >= ctr_multiple) & idle
    )
    low = (
        (F.col("impressions") > low_min_impr) & F.col("product").isin(*K.CLICK_EXCHANGE_PRODUCTS)
        & (F.col("product_ctr") > 0) & (F.col("x_over_norm") <= 1.0 / ctr_multiple) & idle
    )
    side = F.when(high, "HIGH").when(low, "LOW")
    flagged = g.withColumn("side", side).filter(F.col("side").isNotNull())
    lead = F.concat(F.lit("CTR "), percent(F.col("ctr"), 3), F.lit(" is "))
    tail = F.concat(F.lit("× the "), F.col("product"), F.lit(" norm — abnormally "))
    text = F.when(
        F.col("side") == "HIGH",
        F.concat(lead, fixed(F.col("x_over_norm"), 1), tail,
                 F.lit("HIGH (possible invalid traffic)")),
    ).otherwise(
        F.concat(lead, fixed(F.col("x_over_norm"), 2), tail,
                 F.lit("LOW (underdelivering, not converting)"))
    )
    return flagged.select(
        *keys, "impressions", "clicks", "spend", "conversions", "ctr", "product_ctr",
        "x_over_norm", "conv_rate", "side", text.alias("flag"),
    )


def exchange_summary(fact: DataFrame, **thresholds) -> DataFrame:
    flags = one_row_total(
        exchange_flags(fact, **thresholds),
        n=F.count("*"), spend=F.coalesce(F.sum("spend"), F.lit(0.0)),
    )
    g = fact.filter(F.col("exchange").isNotNull()).groupBy("exchange").agg(
        *sums("impressions", "clicks", "spend")
    )
    top = F.max(F.struct(F.col("spend"), F.col("exchange")))
    return g.agg(
        F.count("*").alias("exchanges"),
        ctr(F.sum("clicks"), F.sum("impressions")).alias("book_ctr"),
        money(F.coalesce(F.sum("spend"), F.lit(0))).alias("total_spend"),
        top["exchange"].alias("top_exchange"),
        ratio(top["spend"], F.sum("spend")).alias("top_share"),
    ).select("*", flags["n"].alias("flag_count"), flags["spend"].alias("flag_spend"))
