"""Placement scoring: junk categories and the waste they cause."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions.constants import NOT_IN_EXPORT
from leakscope.functions.names import placement_category
from leakscope.functions.ratios import money, total
from leakscope.sources.exports import count_of, money_of
from leakscope.sources.headers import find_exact_or_part

# Column candidates per role, in order of preference.
ROLES = {
    "placement": ["site/app", "site / app", "app/site", "site", "app", "placement", "domain",
                  "publisher", "inventory", "site name", "app name", "bundle"],
    "impressions": ["impression", "impr", "imps"],
    "clicks": ["click"],
    "spend": ["internal cost", "spend", "cost", "media cost", "amount"],
    "conversions": ["click conversion", "conversion", "conv", "actions"],
    "business_unit": ["client business unit", "business unit"],
    "product": ["product"],
    "strategy": ["strategy type", "strategy"],
}
DIMENSIONS = ["business_unit", "product", "strategy"]


def scoring_columns(df: DataFrame) -> DataFrame:
    """Resolve the export's columns by role; missing measures count 0."""
    found = {role: find_exact_or_part(df.columns, cands) for role, cands in ROLES.items()}
    if found["placement"] is None:
        raise ValueError(f"no placement column among {df.columns}")

    def source(role):
        name = found[role]
        if role in DIMENSIONS or role == "placement":
            return F.col(f"`{name}`").cast("string") if name else F.lit(NOT_IN_EXPORT)
        convert = money_of if role == "spend" else count_of
        return convert(F.col(f"`{name}`")) if name else F.lit(0)

    return df.select(*[source(role).alias(role) for role in ROLES])


def placement_scores(export: DataFrame) -> DataFrame:
    """Every row with its category and concern."""
    verdict = placement_category(F.col("placement"))
    scored = export.withColumn("_v", verdict)
    return scored.withColumns(
        {"category": F.col("_v.category"), "concern": F.col("_v.concern")}
    ).drop("_v")


def block_list(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("concern") == "BLOCK").select(
        "placement", "category", "impressions", "clicks", money("spend").alias("spend"),
        *DIMENSIONS,
    )


def _blocked_groups(export: DataFrame, dims: list[str]) -> DataFrame:
    """Blocked delivery per placement and dimensions.

    The rules look at the name alone, so rows are summed up first and each name is judged once
    per group instead of once per row.
    """
    g = export.groupBy("placement", *dims).agg(total("impressions"), total("spend"))
    return g.filter(placement_category(F.col("placement"))["concern"] == "BLOCK")


def _waste():
    return [
        total("impressions", "blocked_impressions"),
        money(total(F.col("spend"))).alias("blocked_spend"),
        F.countDistinct("placement").alias("blocked_placements"),
    ]


def blocked_waste_by(export: DataFrame, dim: str) -> DataFrame:
    blocked = _blocked_groups(export, [dim]).filter(F.col(dim).isNotNull())
    # One row per placement and value already, so counting rows counts placements.
    return blocked.groupBy(dim).agg(*_waste()[:2], F.count("placement").alias("blocked_placements"))


def blocked_waste(export: DataFrame) -> DataFrame:
    """The three rollups in one pass: (dimension, value) rows by grouping sets."""
    groups = _blocked_groups(export, DIMENSIONS)
    cols = [F.col(d) for d in DIMENSIONS]
    sets = groups.groupingSets([[c] for c in cols], *cols).agg(
        *_waste(), *[F.grouping(d).alias(f"_{d}") for d in DIMENSIONS]
    )
    dimension = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in DIMENSIONS])
    return sets.select(
        dimension.alias("dimension"), F.coalesce(*DIMENSIONS).alias("value"),
        "blocked_impressions", "blocked_spend", "blocked_placements",
    ).filter(F.col("value").isNotNull())


def block_report_summary(export: DataFrame) -> DataFrame:
    groups = export.groupBy("placement").agg(
        F.count("*").alias("n"), total("impressions"), total("spend"),
        *[F.bool_or(F.coalesce(F.col(d), F.lit("")) != NOT_IN_EXPORT).alias(f"_{d}")
          for d in DIMENSIONS],
    )
    block = placement_category(F.col("placement"))["concern"] == "BLOCK"
    judged = groups.withColumn("_block", block)
    has = F.coalesce(F.bool_or(F.col("_business_unit") | F.col("_product") | F.col("_strategy")),
                     F.lit(False))
    return judged.agg(
        total("n", "placements"),
        F.coalesce(F.sum(F.when(F.col("_block"), F.col("n"))), F.lit(0)).alias("block_count"),
        F.coalesce(F.sum(F.when(F.col("_block"), F.col("impressions"))), F.lit(0))
        .alias("blocked_impressions"),
        F.coalesce(F.sum(F.when(F.col("_block"), F.col("spend"))), F.lit(0)).cast("double")
        .alias("blocked_spend"),
        has.alias("has_dimensions"),
    )
