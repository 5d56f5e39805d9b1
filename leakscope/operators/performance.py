"""Performance by partner, product and strategy, with click-rate flags.

Input: rows of any grain with business_unit, client, product, strategy_type, strategy_name,
impressions, clicks, conversions (post-click), view_throughs and internal_cost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.ratios import cpm, ctr, money, ratio, total
from leakscope.functions.text import fixed, percent
from leakscope.operators.norms import one_row_total, sums, with_norm

OVERVIEW_NAMES = {
    "Business Unit": "business_unit", "Client Business Unit": "business_unit",
    "Client": "client", "Product": "product", "Strategy Type": "strategy_type",
    "Strategy Name": "strategy_name", "Impressions": "impressions", "Clicks": "clicks",
    "Click Conversions": "conversions", "View-throughs": "view_throughs",
    "Internal Cost": "internal_cost",
}


def from_overview(df: DataFrame) -> DataFrame:
    """Overview frames under the names the performance tables use."""
    return df.withColumnsRenamed({k: v for k, v in OVERVIEW_NAMES.items() if k in df.columns})


def _cost() -> Column:
    return total("internal_cost")


def perf_by_business_unit(
    fact: DataFrame, zero_conv_min_spend: float = 300.0, tiers=((10000, 0.025), (30000, 0.01))
) -> DataFrame:
    """Totals per partner. The more impressions, the lower the rate that flags the partner."""
    g = fact.filter(F.col("business_unit").isNotNull()).groupBy("business_unit").agg(
        *sums("impressions", "clicks", "conversions", "view_throughs"), _cost()
    )
    flagged = F.lit(False)
    for min_impressions, above in tiers:
        flagged = flagged | ((F.col("impressions") >= min_impressions) & (F.col("ctr") > above))
    return g.withColumns(
        {
            "internal_cost": money("internal_cost"),
            "ctr": ctr(),
            "cost_per_conv": ratio("internal_cost", "conversions", None),
            "zero_conversion_waste": (F.col("conversions") == 0)
            & (F.col("internal_cost") >= zero_conv_min_spend),
        }
    ).withColumn("flagged", flagged)


def _book(fact: DataFrame) -> Column:
    return one_row_total(
        fact,
        ctr=ctr(F.sum("clicks"), F.sum("impressions")),
        cost=F.sum("internal_cost").cast("double"),
    )


def clean_product(product: Column) -> Column:
    return F.when(product.isin(*K.OVERVIEW_PRODUCTS), product).otherwise("Other/Uncategorized")


def perf_by_product(fact: DataFrame) -> DataFrame:
    """Totals per product; values that are no product are pooled into one row."""
    g = fact.groupBy(clean_product(F.col("product")).alias("product")).agg(
        *sums("impressions", "clicks", "conversions"), _cost()
    )
    book = _book(fact)
    cost = F.col("internal_cost").cast("double")
    return g.select(
        "product", "impressions", "clicks", "conversions", cost.alias("internal_cost"),
        ctr().alias("ctr"),
        ratio("conversions", "clicks").alias("click_conv_rate"),
        F.when(book["cost"] != 0, cost / book["cost"]).otherwise(cost).alias("pct_of_spend"),
        (ctr() > book["ctr"]).alias("above_norm"),
    )


def perf_by_strategy(fact: DataFrame) -> DataFrame:
    """Totals per strategy type."""
    known = fact.filter(F.col("strategy_type").isNotNull())
    g = known.groupBy("strategy_type").agg(
        *sums("impressions", "clicks", "conversions", "view_throughs"), _cost()
    )
    return g.select(
        "strategy_type", "impressions", "clicks", "conversions", "view_throughs",
        money("internal_cost").alias("internal_cost"), ctr().alias("ctr"),
        ratio("internal_cost", "conversions", None).alias("cost_per_conv"),
        (ctr() > _book(known)["ctr"]).alias("above_norm"),
    )


def high_ctr_reason(label: Column, norm: Column) -> Column:
    return F.concat(
        F.lit("CTR "), percent(F.col("ctr"), 2), F.lit(" is "),
        fixed(F.col("x_over_norm"), 1), F.lit("× the "), label, F.lit(" norm ("),
        percent(norm, 2), F.lit(")"),
    )


def _above(min_impr: int, multiple: float, floor: float) -> Column:
    return (
        (F.col("impressions") >= min_impr) & (F.col("ctr") >= floor)
        & (F.col("x_over_norm") >= multiple)
    )


def strategy_ctr_flags(
    fact: DataFrame, min_impr: int = 5000, ctr_multiple: float = 3.0, ctr_floor: float = 0.005
) -> DataFrame:
    """Strategies (line items) whose rate is far above their type's; null keys are kept."""
    keys = ["business_unit", "client", "product", "strategy_type", "strategy_name"]
    g = fact.groupBy(*keys).agg(*sums("impressions", "clicks", "conversions"), _cost())
    g = g.withColumns({"internal_cost": money("internal_cost"), "ctr": ctr()})
    flagged = with_norm(g, fact, "strategy_type", "type_ctr").filter(
        _above(min_impr, ctr_multiple, ctr_floor)
    )
    return flagged.select(
        *keys, "impressions", "clicks", "conversions", "internal_cost", "ctr", "type_ctr",
        "x_over_norm",
        high_ctr_reason(F.col("strategy_type"), F.col("type_ctr")).alias("reason"),
        cpm("internal_cost").alias("cpm"),
    )


def client_ctr_flags(
    fact: DataFrame, min_impr: int = 20000, ctr_multiple: float = 3.0, ctr_floor: float = 0.008
) -> DataFrame:
    """Client x product rows whose rate is far above the product's."""
    keys = ["business_unit", "client", "product"]
    product = F.when(F.col("product").isin(*K.OVERVIEW_PRODUCTS), F.col("product"))
    clean = fact.withColumn("product", product.otherwise("Other")).dropna(subset=keys)
    g = clean.groupBy(*keys).agg(*sums("impressions", "clicks"), _cost())
    g = g.withColumns({"internal_cost": money("internal_cost"), "ctr": ctr()})
    flagged = with_norm(g, clean, "product", "product_ctr").filter(
        _above(min_impr, ctr_multiple, ctr_floor)
    )
    return flagged.select(
        *keys, "impressions", "clicks", "internal_cost", "ctr", "product_ctr", "x_over_norm",
        high_ctr_reason(F.col("product"), F.col("product_ctr")).alias("reason"),
        cpm("internal_cost").alias("cpm"),
    )


def insights_summary(fact: DataFrame, zero_conv_min_spend: float = 300.0, **flags) -> DataFrame:
    """One row: totals, partner counts, product spotlight and the number of flags."""
    units = perf_by_business_unit(fact, zero_conv_min_spend)
    waste = F.col("zero_conversion_waste")
    per_unit = one_row_total(
        units,
        n=F.count("*"), zero=F.count_if(waste),
        zero_spend=F.coalesce(F.sum(F.when(waste, F.col("internal_cost"))), F.lit(0.0)),
    )
    spot = F.col("product") == "Social Mirror"
    seen = F.count_if(spot) > 0

    def part(c):
        return F.sum(F.when(spot, F.col(c)))

    flag_count = strategy_ctr_flags(fact, **flags).agg(F.count("*")).scalar()
    return fact.agg(
        total("impressions", "total_impressions"), total("clicks", "total_clicks"),
        money(total(F.col("internal_cost"))).alias("total_cost"),
        F.when(seen, ratio(part("internal_cost"), F.sum("internal_cost")))
        .alias("social_mirror_pct_spend"),
        F.when(seen, ratio(part("conversions"), part("clicks"))).alias("social_mirror_conv_rate"),
        ctr(F.sum("clicks"), F.sum("impressions")).alias("book_ctr"),
    ).select(
        "*", per_unit["n"].alias("business_units"), per_unit["zero"].alias("zero_conv_bu_count"),
        per_unit["zero_spend"].alias("zero_conv_spend"), flag_count.alias("strategy_flag_count"),
    )
