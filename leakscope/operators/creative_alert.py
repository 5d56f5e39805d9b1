"""The alert a creative feed raises, as rows: headline, findings and affected campaigns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.text import grouped
from leakscope.operators.creative_profile import measured, summary_of, written_profile
from leakscope.operators.creative_quality import alert_headline, campaign_blanks, is_alert


def _entry(section: str, count: Column, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), count.cast("bigint").alias("count"), text.alias("text")
    )


def _counted(count: str, tail: str) -> Column:
    return _entry("finding", F.col(count),
                  F.concat(F.col(count).cast("string"), F.lit(" " + tail)))


def _entries(has_urls: bool) -> list[Column]:
    """Headline and findings over the columns of a summary."""
    banners, tagged = F.col("sm_display_size_creatives"), F.col("utm_tagged")
    entries = [
        _entry("headline", F.col("blank_rows"), alert_headline(
            F.concat(F.col("window_start"), F.lit(" → "), F.col("window_end")))),
        _entry("finding", banners, F.concat(
            banners.cast("string"),
            F.lit(" Social Mirror creative(s) named with a display banner size ("),
            grouped(F.col("banner_impressions")),
            F.lit(" impressions) — likely a display asset on a social line"))),
        _counted("perf_no_clicks", "creative(s) delivering with zero clicks"),
        _counted("perf_fatigue", "creative(s) with CTR down sharply across the window"),
        _counted("perf_single_creative",
                 "campaign(s) delivering on a single creative — no rotation"),
        _counted("perf_laggards", "creative(s) at or below ⅓ of their product's CTR norm"),
        _counted("missing_preview_creatives",
                 "creative(s) with no preview image URL — can't be visually QA'd"),
    ]
    if has_urls:
        n = F.col("utm_creatives")
        share = F.when(n > 0, F.floor(tagged * F.lit(100.0) / n + F.lit(0.5)))
        entries.append(_entry("finding", n, F.concat(
            tagged.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" creatives ("),
            share.cast("string"), F.lit("%) are running UTM codes — "),
            F.col("utm_untagged").cast("string"), F.lit(" carry none, "),
            F.col("utm_partial").cast("string"), F.lit(" are partially tagged"))))
    entries.append(_counted("st_low_vcr", "video creative(s) below the completion-rate floor"))
    return entries


def alert_of(prof: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows of the alert of a written profile and its `summary_of`."""
    entries = _entries("click_url" in prof.columns)
    lines = summary.filter(is_alert()).select(
        F.posexplode(F.array(*entries)).alias("position", "_e")
    ).select("_e.section", "position", "_e.count", "_e.text").filter(
        (F.col("section") == "headline") | (F.col("count") > 0))
    ids = ["client", "product", "campaign", "campaign_id", "coverage"]
    affected = campaign_blanks(prof).select(
        F.lit("campaign").alias("section"), F.lit(None).cast("int").alias("position"),
        F.col("impressions").alias("count"),
        F.concat_ws(" | ", *[F.col(c) for c in ids]).alias("text"),
    )
    return lines.unionByName(affected)


def creative_alert_rows(creative: DataFrame, min_impressions: int = 1) -> DataFrame:
    """Rows of the alert, with all affected campaigns (without a position: sinks order them).

    None when there is neither a blank name nor a critical finding.
    """
    prof = written_profile(measured(creative))
    return alert_of(prof, summary_of(prof, min_impressions))
