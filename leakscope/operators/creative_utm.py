"""URL tagging of creatives: what is tagged, how, and how much delivery it carries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.creative import key_count, url_or_empty, with_tags
from leakscope.functions.ratios import ctr, money, ratio, total
from leakscope.functions.text import is_blank
from leakscope.operators.creative_quality import named, present
from leakscope.operators.norms import sums

PLACEMENT_KEYS = ["client", "product", "campaign_id", "creative_id", "creative"]


def _placements(creative: DataFrame) -> DataFrame:
    """One row per creative placement with its URL: the non-blank one with the most impressions.

    Rows are summed per URL first, so URLs are compared and parsed per placement, not per day.
    """
    keys = present(creative, PLACEMENT_KEYS)
    per_url = named(creative).groupBy(*keys, url_or_empty(F.col("click_url")).alias("_url")).agg(
        *sums("impressions", "clicks", "spend")
    )
    used = F.when(F.col("_url") != "", F.struct("impressions", "_url"))
    return per_url.groupBy(*keys).agg(
        F.coalesce(F.max(used)["_url"], F.lit("")).alias("url"),
        F.count_if(F.col("_url") != "").alias("urls_seen"),
        *sums("impressions", "clicks", "spend"),
    )


def utm_by_placement(creative: DataFrame) -> DataFrame:
    rows = with_tags(_placements(creative))
    return rows.withColumns({"spend": money("spend"), "ctr": ctr()})


def creative_key(keys: list[str]) -> Column:
    """What counts as one creative: its id, or its name where the id is blank or absent."""
    if "creative_id" not in keys:
        return F.col("creative")
    return F.when(is_blank(F.col("creative_id")), F.col("creative")).otherwise(
        F.col("creative_id"))


def utm_per_creative(creative: DataFrame) -> DataFrame:
    """One verdict per creative, from the URL of its placement with the most impressions.

    A creative is its id, or its name where the id is blank.
    """
    keys = present(creative, PLACEMENT_KEYS)
    placements = _placements(creative)
    ties = [F.coalesce(F.col(k), F.lit("")).alias(f"k_{k}") for k in keys]
    top = F.max_by(
        F.struct("creative", "client", "product", "url"), F.struct("impressions", *ties)
    )
    g = placements.groupBy(creative_key(keys).alias("creative_key")).agg(
        top.alias("_top"),
        F.countDistinct(F.when(F.col("url") != "", F.col("url"))).alias("distinct_urls"),
        F.countDistinct("campaign_id").alias("campaigns"),
        *sums("impressions", "clicks", "spend"),
    )
    flat = g.select(
        "creative_key", "_top.*", "campaigns", "distinct_urls", "impressions", "clicks",
        money("spend").alias("spend"), ctr().alias("ctr"),
    )
    return with_tags(flat)


def _is_core(url="url"):
    return key_count(F.col(url), K.UTM_CORE) == len(K.UTM_CORE)


def slices() -> dict:
    """Named subsets of the per-creative table; the first and the last three partition it."""
    tagged, no_url = F.col("utm_count") > 0, F.col("url") == ""
    return {
        "tagged": tagged,
        "fully_tagged": _is_core(),
        "partially_tagged": tagged & ~_is_core(),
        "untagged": ~tagged & ~no_url,
        "no_url": no_url,
        "other_tracking_only": ~tagged & (F.col("other_tracking") != ""),
        "multi_url": F.col("distinct_urls") > 1,
    }


def utm_summary(creative: DataFrame) -> DataFrame:
    """Creatives, impressions, spend and share of impressions per slice, from one aggregate."""
    rows = utm_per_creative(creative)

    def part(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    entries = [
        F.struct(
            F.lit(name).alias("slice"), F.count_if(cond).alias("creatives"),
            part(cond, "impressions").alias("impressions"),
            F.round(part(cond, "spend").cast("double"), 2).alias("spend"),
            ratio(part(cond, "impressions"), F.sum("impressions")).alias("impr_pct"),
        )
        for name, cond in slices().items()
    ]
    return rows.agg(F.array(*entries).alias("s")).select(F.inline("s"))


def utm_totals(creative: DataFrame) -> DataFrame:
    """One row: creatives, their placements, and whether a creative is its id or its name."""
    keys = present(creative, PLACEMENT_KEYS)
    placements = named(creative).groupBy(*keys).agg(F.count("*").alias("_rows"))
    per = placements.groupBy(creative_key(keys).alias("_key")).agg(F.count("*").alias("_n"))
    basis = "creative ID" if "creative_id" in keys else "creative name"
    return per.agg(
        F.count("*").alias("creatives"), total("_n", "placements")
    ).withColumn("id_basis", F.lit(basis))


def utm_params(creative: DataFrame) -> DataFrame:
    """Use of each parameter by creatives; keys are exact, not parts of longer ones."""
    rows = utm_per_creative(creative)
    n = rows.agg(F.count("*")).scalar()
    used = rows.filter(F.col("utm_count") > 0).select(
        F.explode(F.split("utm_params", ", ")).alias("parameter"), "impressions"
    )
    return used.groupBy("parameter").agg(
        F.count("*").alias("creatives"), total("impressions")
    ).select("*", ratio(F.col("creatives"), n).alias("pct_of_creatives"))


def utm_by_client(creative: DataFrame) -> DataFrame:
    tagged = F.col("utm_count") > 0
    g = utm_per_creative(creative).groupBy("client").agg(
        F.count("*").alias("creatives"), F.count_if(tagged).alias("tagged"),
        total("impressions"), F.round(F.sum("spend"), 2).alias("spend"),
        F.coalesce(F.sum(F.when(tagged, F.col("impressions"))), F.lit(0))
        .alias("tagged_impressions"),
    )
    return g.withColumns(
        {
            "untagged": F.col("creatives") - F.col("tagged"),
            "tagged_pct": ratio("tagged", "creatives", None),
            "tagged_impr_pct": ratio("tagged_impressions", "impressions"),
        }
    )


def utm_untagged(creative: DataFrame) -> DataFrame:
    """Creatives without a UTM key, those without a URL included."""
    return utm_per_creative(creative).filter(F.col("utm_count") == 0)


def utm_partial(creative: DataFrame) -> DataFrame:
    return utm_per_creative(creative).filter((F.col("utm_count") > 0) & ~_is_core())


def utm_multi_url(creative: DataFrame) -> DataFrame:
    return utm_per_creative(creative).filter(F.col("distinct_urls") > 1)
