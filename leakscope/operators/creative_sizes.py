"""Delivery and completion by creative size and type."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.creative import first_size, size_family
from leakscope.functions.ratios import cpm, ctr, money, ratio, total
from leakscope.functions.text import fold, is_blank, strip
from leakscope.operators.creative_quality import named, present
from leakscope.operators.norms import sums

QUARTILES = ["q25", "q50", "q75", "q100"]


def sized(creative: DataFrame) -> DataFrame:
    """Named rows with size, size family and type; a blank size is read from the name."""
    rows = named(creative)
    size = first_size(F.col("creative"))
    from_name = F.lit(True)
    if "creative_size" in creative.columns:
        from_name = is_blank(F.col("creative_size"))
        stated = F.replace(fold(F.col("creative_size")), F.lit(" "), F.lit(""))
        size = F.when(from_name, size).otherwise(stated)
    kind = F.lit(K.NOT_SPECIFIED)
    if "creative_type" in creative.columns:
        kind = F.when(is_blank(F.col("creative_type")), K.NOT_SPECIFIED).otherwise(
            strip(F.col("creative_type"))
        )
    size = F.coalesce(F.when(size != "", size), F.lit(K.NOT_SPECIFIED))
    quartiles = {q: F.lit(0) for q in QUARTILES if q not in creative.columns}
    return rows.withColumns({"size": size, "type": kind, "size_from_name": from_name, **quartiles})


def _rollup(creative: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, distinct creatives and campaigns, and rates per key.

    Summed per creative and campaign first: the two distinct counts then expand groups, not rows.
    """
    rows = sized(creative)
    measures = ["impressions", "clicks", "conversions", "spend", *QUARTILES]
    per = rows.groupBy(*keys, "campaign_id", "creative").agg(*sums(*measures))
    g = per.groupBy(*keys).agg(
        F.countDistinct("creative").alias("creatives"),
        F.countDistinct("campaign_id").alias("campaigns"), *sums(*measures),
    )
    everything = rows.agg(F.greatest(F.coalesce(F.sum("impressions"), F.lit(0)), F.lit(1))).scalar()
    return g.select(
        *keys, "creatives", "campaigns", "impressions", "clicks", "conversions",
        money("spend").alias("spend"), *QUARTILES, ctr().alias("ctr"), cpm().alias("cpm"),
        ratio("conversions", "impressions").alias("conv_rate"),
        ratio("q100", "impressions").alias("vcr"),
        ratio("q25", "impressions").alias("q25_rate"),
        ratio(F.col("impressions"), everything).alias("pct_of_impr"),
    )


def perf_by_size(creative: DataFrame) -> DataFrame:
    return _rollup(creative, ["size"]).withColumn("family", size_family(F.col("size")))


def perf_by_type(creative: DataFrame) -> DataFrame:
    return _rollup(creative, ["type"])


def perf_by_type_size(creative: DataFrame) -> DataFrame:
    return _rollup(creative, ["product", "type", "size"])


def perf_by_product_size(creative: DataFrame, min_impr: int = 5000) -> DataFrame:
    return _rollup(creative, ["product", "size"]).filter(F.col("impressions") >= min_impr)


def video_completion(creative: DataFrame) -> DataFrame:
    """Quartile rates and drop-off per creative that reached a first quartile.

    Without a single completed view in the feed the table is empty.
    """
    keys = present(creative, ["client", "product", "campaign_id", "creative_id", "creative"])
    rows = named(creative)
    completed = rows.agg(F.coalesce(F.sum("q100"), F.lit(0))).scalar()
    g = rows.groupBy(*keys).agg(*sums("impressions", "spend", *QUARTILES)).filter(
        (F.col("q25") > 0) & (completed > 0)
    )
    kept = F.col("q100").cast("double") / F.col("q25").cast("double")
    return g.select(
        *keys, "impressions", money("spend").alias("spend"), *QUARTILES,
        ratio("q100", "impressions").alias("vcr"),
        *[ratio(q, "impressions").alias(f"{q}_rate") for q in ("q25", "q50", "q75")],
        (1 - kept).alias("dropoff"),
    )


def low_completion(creative: DataFrame, min_impr: int = 5000, floor: float = 0.50) -> DataFrame:
    return video_completion(creative).filter(
        (F.col("impressions") >= min_impr) & (F.col("vcr") < floor)
    )


def size_type_counts(creative: DataFrame, min_impr: int = 5000, floor: float = 0.50) -> DataFrame:
    """One row: distinct sizes and types, sizes read from names, completion counts."""
    per = sized(creative).groupBy("size", "type").agg(
        F.count_if("size_from_name").alias("from_name")
    )
    low = (F.col("impressions") >= min_impr) & (F.col("vcr") < floor)
    done = video_completion(creative).agg(
        F.struct(F.count("*").alias("n"), F.count_if(low).alias("low"))
    ).scalar()
    return per.agg(
        F.countDistinct("size").alias("sizes"), F.countDistinct("type").alias("types"),
        total("from_name", "size_from_name"),
    ).select("*", done["n"].alias("completion_creatives"), done["low"].alias("low_vcr"))
