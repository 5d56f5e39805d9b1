"""Canonical creative rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.sources.exports import count_of, date_of, money_of

# Canonical column -> the headers it may have, in order of preference.
TEXT_ROLES = {
    "business_unit": ["Client Business Unit", "Business Unit", "client_business_unit"],
    "client": ["Client", "client"],
    "product": ["Product 2", "Product", "product_2"],
    "strategy_type": ["Strategy Type", "strategy_type"],
    "strategy_name": ["Strategy Name", "strategy_name"],
    "campaign": ["Campaign Pool Name", "campaign_pool_name", "Campaign Name"],
    "campaign_id": ["Campaign ID", "campaign_id"],
    "campaign_pool_id": ["Campaign Pool ID", "campaign_pool_id"],
    "creative_id": ["Creative ID", "creative_id", "Creative Id"],
    "creative": ["Creative Name", "creative_name", "Creative", "creative"],
    "creative_size": ["Creative Size", "creative_size"],
    "creative_type": ["Creative Type", "creative_type"],
    "click_url": ["Clickthrough URL", "creative_clickthrough_url",
                  "Creative Clickthrough URL", "clickthrough_url"],
    "preview_url": ["Preview Image URL", "preview_image_url", "preview_url"],
}
NUMBER_ROLES = {
    "impressions": ["Impressions", "impressions"],
    "clicks": ["Clicks", "clicks"],
    "click_conversions": ["Post Click Conversions", "post_click_conversions"],
    "view_conversions": ["Post View Conversions", "post_view_conversions"],
    "spend": ["Billable Spend", "billable_spend", "Internal Cost", "Total Spend"],
    "q25": ["25% Completed", "25_completed", "completed_25"],
    "q50": ["50% Completed", "50_completed", "completed_50"],
    "q75": ["75% Completed", "75_completed", "completed_75"],
    "q100": ["100% Completed", "100_completed", "completed_100"],
}
# Columns the audits always need; the others stay absent when the export lacks them.
ALWAYS = ["business_unit", "client", "product", "campaign", "campaign_id", "creative",
          "impressions", "clicks", "spend"]


def normalize_creative(df: DataFrame) -> DataFrame:
    """Creative export -> canonical rows. Conversions are click and view conversions."""

    def found(names):
        return next((n for n in names if n in df.columns), None)

    if found(TEXT_ROLES["creative"]) is None:
        raise ValueError("the export has no creative name column")
    date = found(["Date", "date"])
    out = [(date_of(F.col(f"`{date}`")) if date else F.lit(None).cast("date")).alias("date")]
    for role, names in TEXT_ROLES.items():
        name = found(names)
        if name or role in ALWAYS:
            value = F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")
            out.append(value.alias(role))
    numbers = {}
    for role, names in NUMBER_ROLES.items():
        name = found(names)
        if name or role in ALWAYS:
            convert = money_of if role == "spend" else count_of
            numbers[role] = convert(F.col(f"`{name}`")) if name else convert(F.lit(0))
    zero = F.lit(0).cast("bigint")
    conversions = numbers.pop("click_conversions", zero) + numbers.pop("view_conversions", zero)
    out += [c.alias(role) for role, c in numbers.items()]
    return df.select(*out, conversions.alias("conversions"))
