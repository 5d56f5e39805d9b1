"""Data quality of a creative feed: blank names, trafficking, asset and metric checks.

Input: canonical creative rows (see `sources.creatives.normalize_creative`). Columns an export
does not carry are absent, and the checks that need them are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.creative import sizes_in
from leakscope.functions.names import blank_reason
from leakscope.functions.ratios import money, total
from leakscope.functions.text import date_or, fold, is_blank, strip
from leakscope.operators.norms import sums

CAMPAIGN_KEYS = [
    "client", "business_unit", "product", "campaign", "campaign_id", "campaign_pool_id",
    "creative_id",
]
CREATIVE_KEYS = ["client", "product", "campaign", "campaign_id", "creative_id", "creative"]
GROUPED_CHECKS = ["sm_display_size", "sm_social_size", "format_mismatch"]
# What decides every check but the two on single rows' metrics.
_TEXT_KEYS = ["creative", "product", "business_unit", "creative_id", "preview_url", "click_url"]


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def named(creative: DataFrame) -> DataFrame:
    """Rows with a usable creative name."""
    return creative.filter(blank_reason(F.col("creative")).isNull())


def _banner(c: Column) -> Column:
    return F.arrays_overlap(c, F.array(*[F.lit(s) for s in K.BANNER_SIZES]))


def with_parts(df: DataFrame) -> DataFrame:
    """Add what the text checks look at: the name's issue and sizes, and the folded product.

    As columns they are worked out once per row, however many checks refer to them.
    """
    return df.withColumns(
        {
            "_issue": blank_reason(F.col("creative")),
            "_sizes": sizes_in(F.col("creative")),
            "_product": F.coalesce(fold(F.col("product")), F.lit("")),
        }
    )


def text_checks(columns: list[str]) -> dict[str, Column]:
    """Checks that follow from a row's texts, over the columns of `with_parts`."""
    name, product, sizes = F.col("creative"), F.col("_product"), F.col("_sizes")
    ok = F.col("_issue").isNull()
    social = product == "social mirror"
    checks = {
        "blank_creative": ~ok,
        "sm_display_size": ok & social & _banner(sizes),
        "sm_social_size": ok & social & (F.size(sizes) > 0) & ~_banner(sizes),
        "format_mismatch": ok & (
            (product.isin(*K.VIDEO_PRODUCTS) & name.rlike(K.IMAGE_FILE))
            | (product.isin(*K.STILL_PRODUCTS) & name.rlike(K.VIDEO_FILE))
        ),
    }
    if "preview_url" in columns:
        checks["missing_preview"] = ok & is_blank(F.col("preview_url"))
    if "click_url" in columns:
        no_url = is_blank(F.col("click_url"))
        checks["missing_click_url"] = ok & no_url
        checks["no_utm"] = ok & ~no_url & ~F.lower("click_url").contains("utm_")
    if "creative_id" in columns:
        checks["missing_creative_id"] = ok & is_blank(F.col("creative_id"))
    checks["unmapped_product"] = ~product.isin(*K.CREATIVE_PRODUCTS) & ~product.isin("", "nan")
    unit = F.coalesce(strip(F.col("business_unit")), F.lit(""))
    checks["missing_bu"] = unit.isin("", "nan", "None")
    return checks


def metric_checks() -> dict[str, Column]:
    """Checks on the numbers of one row."""
    impr, clicks, spend = F.col("impressions"), F.col("clicks"), F.col("spend")
    return {
        "impossible_metrics": (clicks > impr) | (impr < 0) | (clicks < 0) | (spend < 0),
        "delivery_no_spend": (impr > 0) & (spend <= 0),
    }


def conflicting_ids(groups: DataFrame) -> DataFrame:
    """Creative ids that occur under several usable names; blank ids identify nothing."""
    pairs = groups.filter(~is_blank(F.col("creative_id"))).groupBy("creative_id", "creative").agg(
        total("rows"), total("impressions"), total("spend")
    )
    return pairs.groupBy("creative_id").agg(
        F.count("*").alias("names"), total("rows"), total("impressions"),
        money(total(F.col("spend"))).alias("spend"),
    ).filter(F.col("names") > 1)


def id_name_conflict(creative: DataFrame) -> DataFrame:
    rows = named(creative).withColumn("rows", F.lit(1))
    return conflicting_ids(rows)


def creative_checks(creative: DataFrame) -> DataFrame:
    """One row per check: rows, impressions and spend it concerns.

    Trafficking checks also count the creatives they concern; for the others that is null. Rows
    are first summed over the texts that decide the checks, so names are matched against the
    patterns once per creative and not once per day, then over names. All checks are then one
    conditional aggregate whose single row is unfolded.
    """
    row_checks = metric_checks()
    groups = creative.groupBy(*present(creative, _TEXT_KEYS)).agg(
        F.count("*").alias("rows"), *sums("impressions", "spend"),
        *[F.count_if(c).alias(f"{k}_rows") for k, c in row_checks.items()],
        *[F.coalesce(F.sum(F.when(c, F.col(m))), F.lit(0)).alias(f"{k}_{m}")
          for k, c in row_checks.items() for m in ("impressions", "spend")],
    )
    text = text_checks(creative.columns)
    measures = ("rows", "impressions", "spend")
    marked = with_parts(groups).withColumns({f"is_{k}": c for k, c in text.items()})
    per_name = marked.groupBy("creative").agg(
        *[F.sum(F.when(F.col(f"is_{k}"), F.col(m))).alias(f"{k}_{m}")
          for k in text for m in measures],
        *[total(f"{k}_{m}") for k in row_checks for m in measures],
        *[F.bool_or(f"is_{k}").alias(f"any_{k}") for k in GROUPED_CHECKS],
    )

    def finding(key, rows, impressions, spend, creatives=None):
        label, severity = K.CREATIVE_CHECKS[key]
        return F.struct(
            F.lit(key).alias("key"), F.lit(label).alias("label"),
            F.lit(severity).alias("severity"),
            F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows"),
            F.coalesce(impressions, F.lit(0)).cast("bigint").alias("impressions"),
            F.coalesce(spend, F.lit(0)).cast("double").alias("spend"),
            (F.lit(None) if creatives is None else creatives).cast("bigint").alias("creatives"),
        )

    findings = [
        finding(k, *[F.sum(f"{k}_{m}") for m in measures],
                F.count_if(f"any_{k}") if k in GROUPED_CHECKS else None)
        for k in [*text, *row_checks]
    ]
    checks = per_name.agg(F.array(*findings).alias("f")).select(F.inline("f"))
    if "creative_id" not in creative.columns:
        return checks
    usable = marked.filter(~F.col("is_blank_creative"))
    conflict = conflicting_ids(usable).agg(
        finding("id_name_conflict", F.sum("rows"), F.sum("impressions"), F.sum("spend")).alias("s")
    )
    return checks.unionByName(conflict.select("s.*"))


def creative_check_rows(creative: DataFrame, key: str) -> DataFrame:
    """The rows behind one check, with the sizes found in the name."""
    marked = with_parts(creative)
    if key == "id_name_conflict":
        ids = id_name_conflict(creative).select("creative_id")
        rows = marked.filter(F.col("_issue").isNull()).join(ids, "creative_id", "left_semi")
    else:
        rows = marked.filter((text_checks(creative.columns) | metric_checks())[key])
    sizes = F.array_join(F.array_distinct("_sizes"), ", ")
    return rows.select(*creative.columns, F.col("_issue").alias("issue"), sizes.alias("sizes"))


def blank_campaigns(creative: DataFrame) -> DataFrame:
    """Campaigns that carry blank creative names, with how much of them is affected."""
    return campaign_blanks(creative.withColumns(
        {"rows": F.lit(1), "first": F.col("date"), "last": F.col("date")}))


def campaign_blanks(groups: DataFrame) -> DataFrame:
    """`blank_campaigns` of rows, or of sums of them, that hold rows, first and last day.

    One pass: all rows are summed per campaign and name, and blank and total figures come from
    the same aggregate. The issue mix has two possible members, so it is two flags.
    """
    keys = present(groups, CAMPAIGN_KEYS)
    per = groups.groupBy(*keys, "creative").agg(
        total("rows"), *sums("impressions", "clicks", "spend"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    ).withColumn("_issue", blank_reason(F.col("creative")))
    bad = F.col("_issue").isNotNull()

    def of_blank(c):
        return F.coalesce(F.sum(F.when(bad, F.col(c))), F.lit(0)).alias(c)

    g = per.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(bad, F.col("rows"))), F.lit(0)).alias("blank_rows"),
        total("rows", "total_rows"), *[of_blank(c) for c in ("impressions", "clicks", "spend")],
        F.concat_ws(", ", *[F.when(F.bool_or(F.col("_issue") == i), F.lit(i))
                            for i in ("empty", "placeholder")]).alias("issue"),
        F.min(F.when(bad, F.col("first"))).alias("first"),
        F.max(F.when(bad, F.col("last"))).alias("last"),
    ).filter(F.col("blank_rows") > 0)
    part = F.concat(
        F.col("blank_rows").cast("string"), F.lit(" of "), F.col("total_rows").cast("string"),
        F.lit(" rows"),
    )
    return g.select(
        *keys, "issue",
        F.when(F.col("blank_rows") >= F.col("total_rows"), "every row").otherwise(part)
        .alias("coverage"),
        "blank_rows", "impressions", "clicks", money("spend").alias("spend"),
        date_or(F.col("first"), "NaT").alias("first_seen"),
        date_or(F.col("last"), "NaT").alias("last_seen"),
    )


def blank_campaigns_delivering(creative: DataFrame, min_impressions: int = 1) -> DataFrame:
    return blank_campaigns(creative).filter(F.col("impressions") >= max(min_impressions, 1))


def blank_rows(creative: DataFrame) -> DataFrame:
    issue = blank_reason(F.col("creative"))
    keep = present(creative, [
        "date", "business_unit", "client", "product", "strategy_type", "strategy_name",
        "campaign", "campaign_id", "campaign_pool_id", "creative_id", "creative", "impressions",
        "clicks",
    ])
    return creative.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(
        *keep, money("spend").alias("spend"), "issue"
    )


def blank_by_client(creative: DataFrame) -> DataFrame:
    per = blank_campaigns(creative).groupBy("client", "campaign_id").agg(
        *sums("blank_rows", "impressions", "spend")
    )
    return per.groupBy("client").agg(
        F.count("campaign_id").alias("campaigns"), *sums("blank_rows", "impressions", "spend")
    )


def creative_flags_grouped(creative: DataFrame) -> DataFrame:
    """Trafficking findings per creative instead of per day."""
    keys = present(creative, CREATIVE_KEYS)
    checks = text_checks([])
    per = with_parts(creative.groupBy(*keys).agg(
        F.count("*").alias("days"), *sums("impressions", "clicks", "spend")
    )).withColumn(
        "key", F.explode(F.array_compact(F.array(*[
            F.when(checks[k], F.lit(k)) for k in GROUPED_CHECKS
        ])))
    )
    sizes = F.array_join(F.array_distinct("_sizes"), ", ")
    return per.select(
        "key", *keys, sizes.alias("sizes"), "days", "impressions", "clicks",
        money("spend").alias("spend"),
    )


def missing_preview_by_creative(creative: DataFrame) -> DataFrame:
    keys = present(creative, CREATIVE_KEYS)
    rows = named(creative).filter(is_blank(F.col("preview_url")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("days"), *sums("impressions", "clicks"),
        money(total(F.col("spend"))).alias("spend"),
    )


def alert_headline(label: Column | None = None) -> Column:
    """Headline of an alert from the columns of a creative summary."""
    tail = F.concat(F.lit(" — "), label) if label is not None else F.lit("")

    def text(before, count, after):
        return F.concat(F.lit(before), F.col(count).cast("string"), F.lit(after), tail)

    return (
        F.when(
            F.col("blank_campaigns_delivering") > 0,
            text("⚠ Creative QA: ", "blank_campaigns_delivering",
                 " campaign(s) delivering with NO creative name"),
        )
        .when(F.col("blank_rows") > 0,
              text("Creative QA: ", "blank_rows", " blank creative row(s)"))
        .when(F.col("critical_issues") > 0,
              text("⚠ Creative QA: ", "critical_issues", " trafficking issue(s)"))
        .otherwise(F.concat(F.lit("Creative QA: clean"), tail))
    )


def is_alert() -> Column:
    """An alert is due for any blank name or critical finding."""
    return (F.col("blank_rows") > 0) | (F.col("critical_issues") > 0)


