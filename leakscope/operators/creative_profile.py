"""All headline figures of a creative feed from one small table of mergeable sums.

A feed is first summed per combination of its text columns (`profile`). Names, checks, campaigns,
rotation, rates, fatigue, tagging, sizes and completion then all follow from that table, which is
written once; each family of figures is one small aggregate that gives one row, and a last
aggregate folds these rows into one. The feed itself is read twice: for the ends of its window and
for the sums.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.ratios import ctr, money, ratio, total
from leakscope.lineage import written
from leakscope.operators import creative_performance as P
from leakscope.operators import creative_quality as Q
from leakscope.operators.creative_sizes import sized, video_completion
from leakscope.operators.creative_utm import slices, utm_per_creative
from leakscope.operators.norms import with_norm

PROFILE_KEYS = [
    "client", "business_unit", "product", "campaign", "campaign_id", "campaign_pool_id",
    "creative_id", "creative", "creative_size", "creative_type", "click_url", "preview_url",
]
MEASURES = ["impressions", "clicks", "spend", "conversions", "q25", "q50", "q75", "q100"]
FEATURES = {
    "has_creative_id": "creative_id", "has_click_url": "click_url",
    "has_preview_url": "preview_url", "has_quartiles": "q25",
    "has_creative_size": "creative_size", "has_creative_type": "creative_type",
}


def measured(creative: DataFrame) -> DataFrame:
    """Each row with its texts, its day, its measures and what the checks on numbers find in it.

    Sums of these rows can be added up again: see `daily_sums` and `profile`.
    """
    found = {}
    for key, check in Q.metric_checks().items():
        found[f"{key}_rows"] = F.coalesce(check, F.lit(False)).cast("long")
        for m in ("impressions", "spend"):
            found[f"{key}_{m}"] = F.when(check, F.col(m))
    return creative.select(
        "date", *Q.present(creative, PROFILE_KEYS), *Q.present(creative, MEASURES),
        F.lit(1).cast("long").alias("rows"), *[c.alias(n) for n, c in found.items()])


def _sums(df: DataFrame) -> list[Column]:
    return [total(c) for c in df.columns if c not in ("date", *PROFILE_KEYS)]


def daily_sums(rows: DataFrame) -> DataFrame:
    """`measured` rows, or such sums of several batches, summed per day and text columns."""
    return rows.groupBy("date", *Q.present(rows, PROFILE_KEYS)).agg(*_sums(rows))


def profile(rows: DataFrame) -> DataFrame:
    """`measured` rows or `daily_sums` per combination of texts, with days and early delivery.

    Early is the first half of the window of named rows; rows without a date are late.
    """
    # names are matched against the patterns once each, not once per row
    days = rows.groupBy("creative").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    half = F.floor(F.datediff(F.max("z"), F.min("a")) / 2).cast("int")
    middle = Q.named(days).agg(F.date_add(F.min("a"), half)).scalar()
    marked = rows.withColumn("_early", F.coalesce(F.col("date") <= middle, F.lit(False)))
    return marked.groupBy(*Q.present(rows, PROFILE_KEYS)).agg(
        *_sums(rows), F.min("date").alias("first"), F.max("date").alias("last"),
        *[F.coalesce(F.sum(F.when(F.col("_early"), F.col(m))), F.lit(0)).alias(f"early_{m}")
          for m in ("impressions", "clicks")])


def with_verdicts(prof: DataFrame) -> DataFrame:
    """A profile with the issue of each name and what the checks of texts find, as columns."""
    checks = Q.text_checks(prof.columns)
    marked = Q.with_parts(prof).withColumns({f"is_{k}": c for k, c in checks.items()})
    return marked.withColumnRenamed("_issue", "issue").drop("_sizes", "_product")


def written_profile(rows: DataFrame) -> DataFrame:
    """The profile of `measured` rows or sums of them, written: what all figures are made from."""
    return written(with_verdicts(profile(rows)), "creative-profile")


def _named(prof: DataFrame) -> DataFrame:
    return prof.filter("issue is null")


# --- families of figures, one row each --------------------------------------------------------


def _names(prof: DataFrame) -> DataFrame:
    """Totals, blanks, window and the checks, over one row per creative name."""
    checks = [c[3:] for c in prof.columns if c.startswith("is_")]
    listed = [k for k in [*Q.GROUPED_CHECKS, "missing_preview"] if k in checks]
    per = prof.groupBy("creative", "issue").agg(
        total("rows"), total("impressions"), total("spend"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.coalesce(F.sum(F.when(F.col(f"is_{k}"), F.col("rows"))), F.lit(0)).alias(f"{k}_rows")
          for k in checks],
        *[total(f"{k}_rows") for k in Q.metric_checks()],
        F.coalesce(F.sum(F.when(F.col("is_sm_display_size"), F.col("impressions"))), F.lit(0))
        .alias("banner_impressions"),
        *[F.bool_or(f"is_{k}").alias(f"any_{k}") for k in listed],
    )
    bad = F.col("issue").isNotNull()

    def part(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    def rows_of(severity=None):
        keys = [k for k in [*checks, *Q.metric_checks()]
                if severity in (None, K.CREATIVE_CHECKS[k][1])]
        return reduce(lambda a, b: a + b, [F.coalesce(F.sum(f"{k}_rows"), F.lit(0)) for k in keys])

    return per.agg(
        total("rows"), total("impressions"), money(total(F.col("spend"))).alias("spend"),
        F.count_if(~bad).alias("creatives"),
        F.min("first").alias("window_low"), F.max("last").alias("window_high"),
        F.min(F.when(~bad, F.col("first"))).alias("named_low"),
        F.max(F.when(~bad, F.col("last"))).alias("named_high"),
        part(bad, "rows").alias("blank_rows"),
        part(F.col("issue") == "empty", "rows").alias("blank_empty"),
        part(F.col("issue") == "placeholder", "rows").alias("blank_placeholder"),
        part(bad, "impressions").alias("blank_impressions"),
        money(part(bad, "spend")).alias("blank_spend"),
        ratio(part(bad, "impressions"), F.sum("impressions")).alias("blank_impr_pct"),
        ratio(part(bad, "spend"), F.sum("spend")).alias("blank_spend_pct"),
        *[F.count_if(f"any_{k}").alias(f"{k}_creatives") for k in listed],
        total("banner_impressions"), rows_of().alias("check_rows"),
        rows_of("critical").alias("critical_rows"), rows_of("warn").alias("warn_rows"),
    )


def _conflicts(prof: DataFrame) -> DataFrame:
    return Q.conflicting_ids(_named(prof)).agg(total("rows", "conflict_rows"))


def _campaigns(prof: DataFrame, floor: int) -> DataFrame:
    return Q.campaign_blanks(prof).agg(
        F.count("*").alias("blank_campaigns"),
        F.count_if(F.col("impressions") >= floor).alias("blank_campaigns_delivering"),
        F.countDistinct("client").alias("blank_clients"))


def _roster(prof: DataFrame) -> DataFrame:
    rows = _named(prof)
    return rows.groupBy(*Q.present(prof, P.ROSTER_KEYS)).agg(
        *[total(m) for m in ("impressions", "clicks", "spend", "conversions")]
    ).withColumns({"spend": money("spend"), "ctr": ctr()})


def _families(prof: DataFrame, min_impr: int, noclick_impr: int, noconv_spend: float):
    rated = with_norm(_roster(prof), _named(prof), "product", "product_ctr")
    big = P.clickable() & (F.col("impressions") >= min_impr)
    quiet = P.clickable() & (F.col("clicks") == 0) & (F.col("impressions") >= noclick_impr)
    idle = (F.col("conversions") == 0) & (F.col("spend") >= noconv_spend)

    def spend_of(cond):
        return F.round(F.coalesce(F.sum(F.when(cond, F.col("spend"))), F.lit(0.0)), 2)

    return rated.agg(
        F.count("*").alias("creative_campaign_pairs"),
        F.count_if(big & (F.col("x_over_norm") >= 3) & (F.col("clicks") > 0)).alias("winners"),
        F.count_if(big & (F.col("x_over_norm") <= 1 / 3.0)).alias("laggards"),
        F.count_if(quiet).alias("no_clicks"), spend_of(quiet).alias("no_clicks_spend"),
        F.count_if(idle).alias("no_conv"), spend_of(idle).alias("no_conv_spend"))


def _rotation(prof: DataFrame, min_impr: int) -> DataFrame:
    """Campaigns on one creative, and those where one roster row holds four fifths.

    Only one row of a campaign can hold so much, so the largest one decides.
    """
    camps = _roster(prof).groupBy(*Q.present(prof, P.ROTATION_KEYS)).agg(
        F.countDistinct("creative").alias("creatives"), F.max("impressions").alias("top"),
        total("impressions"))
    large = F.col("impressions") >= min_impr
    return camps.agg(
        F.count_if(large & (F.col("creatives") == 1)).alias("single_creative"),
        F.count_if(large & (F.col("creatives") >= 3) & (ratio("top", "impressions") >= 0.8))
        .alias("dominant"))


def _reuse(prof: DataFrame) -> DataFrame:
    per = _named(prof).groupBy("creative").agg(F.countDistinct("client").alias("clients"))
    return per.agg(F.count_if(F.col("clients") > 1).alias("dupe_names"))


def _fatigue(prof: DataFrame, min_impr: int = 5000, drop: float = 0.40) -> DataFrame:
    keys = Q.present(prof, ["client", "product", "campaign_id", "creative"])
    g = _named(prof).groupBy(*keys).agg(
        *[total(c) for c in ("impressions", "clicks", "early_impressions", "early_clicks")])
    late = F.col("impressions") - F.col("early_impressions")
    a = ctr("early_clicks", "early_impressions")
    b = ctr(F.col("clicks") - F.col("early_clicks"), late)
    enough = (F.col("early_impressions") >= min_impr) & (late >= min_impr) & P.clickable()
    fell = F.when(a > 0, 1 - b / a).otherwise(0.0) >= drop
    return g.agg(F.count_if(enough & (a > 0) & fell).alias("tired"))


def _tags(prof: DataFrame) -> DataFrame:
    parts = slices()

    def count(name):
        return F.count_if(parts[name])

    return utm_per_creative(prof).agg(
        F.count("*").alias("utm_creatives"), count("tagged").alias("utm_tagged"),
        ratio(count("tagged"), F.count("*")).alias("utm_tagged_pct"),
        count("fully_tagged").alias("utm_fully_tagged"),
        count("partially_tagged").alias("utm_partial"),
        count("untagged").alias("utm_untagged"), count("no_url").alias("utm_no_url"),
        ratio(F.sum(F.when(parts["tagged"], F.col("impressions"))), F.sum("impressions"))
        .alias("utm_tagged_impr_pct"))


_NO_TAGS = {
    **{f"utm_{n}": "bigint" for n in ("creatives", "tagged", "fully_tagged", "partial",
                                      "untagged", "no_url")},
    "utm_tagged_pct": "double", "utm_tagged_impr_pct": "double"}


def _sizes(prof: DataFrame) -> DataFrame:
    return sized(prof).groupBy("size", "type").agg(
        F.sum(F.when(F.col("size_from_name"), F.col("rows"))).alias("from_name")
    ).agg(F.countDistinct("size").alias("sizes"), F.countDistinct("type").alias("types"),
          total("from_name", "size_from_name"))


def _completion(prof: DataFrame, min_impr: int = 5000, floor: float = 0.50) -> DataFrame:
    low = (F.col("impressions") >= min_impr) & (F.col("vcr") < floor)
    if "q100" not in prof.columns:
        return prof.agg(F.lit(0).cast("long").alias("completion_creatives"),
                        F.lit(0).cast("long").alias("low_vcr"))
    return video_completion(prof).agg(
        F.count("*").alias("completion_creatives"), F.count_if(low).alias("low_vcr"))


def _folded(families: list[DataFrame]) -> DataFrame:
    """One row from families of one row each that have different columns."""
    types = {name: kind for df in families for name, kind in df.dtypes}
    rows = [
        df.selectExpr(*[c if c in df.columns else f"cast(null as {kind}) as {c}"
                        for c, kind in types.items()]) for df in families]
    return reduce(lambda a, b: a.union(b), rows).agg(*[F.max(c).alias(c) for c in types])


COUNTS = ["creatives", "creative_campaign_pairs", "winners", "laggards", "no_clicks",
           "no_clicks_spend", "no_conv", "no_conv_spend", "fatigue", "single_creative",
           "dominant", "dupe_names"]
SIZE_COUNTS = ["sizes", "types", "size_from_name", "completion_creatives", "low_vcr"]


def _performance(prof: DataFrame, min_impr, noclick_impr, noconv_spend) -> list[DataFrame]:
    return [
        _families(prof, min_impr, noclick_impr, noconv_spend), _rotation(prof, min_impr),
        _reuse(prof), _fatigue(prof)]


def _with_fatigue(row: DataFrame, min_days: int = 3) -> DataFrame:
    """A window of fewer days has no early and late half to compare."""
    long_enough = F.datediff("named_high", "named_low") >= min_days
    return row.withColumn("fatigue", F.when(long_enough, F.col("tired")).otherwise(0))


def performance_counts(creative: DataFrame, min_impr: int = 10000, noclick_impr: int = 5000,
                       noconv_spend: float = 50.0) -> DataFrame:
    """One row with the size of every family of creatives."""
    prof = written_profile(measured(creative))
    rows = _named(prof)
    head = rows.agg(F.countDistinct("creative").alias("creatives"),
                    F.min("first").alias("named_low"), F.max("last").alias("named_high"))
    row = _folded([head, *_performance(prof, min_impr, noclick_impr, noconv_spend)])
    return _with_fatigue(row).select(*COUNTS)


def summary_of(prof: DataFrame, min_impressions: int = 1) -> DataFrame:
    """`creative_summary` of a written profile, with the figures that the alert needs besides."""
    floor = max(min_impressions, 1)
    families = [_names(prof), _campaigns(prof, floor), _sizes(prof), _completion(prof),
                *_performance(prof, 10000, 5000, 50.0)]
    if "creative_id" in prof.columns:
        families.append(_conflicts(prof))
    if "click_url" in prof.columns:
        families.append(_tags(prof))
    row = _with_fatigue(_folded(families))
    missing = {c: F.lit(None).cast(t) for c, t in _NO_TAGS.items() if c not in row.columns}
    conflict = F.col("conflict_rows") if "creative_id" in prof.columns else F.lit(0)
    severity = K.CREATIVE_CHECKS["id_name_conflict"][1]
    critical = F.col("critical_rows") + (conflict if severity == "critical" else F.lit(0))
    warn = F.col("warn_rows") + (conflict if severity == "warn" else F.lit(0))
    preview = (F.col("missing_preview_creatives") if "preview_url" in prof.columns
               else F.lit(0).cast("long"))
    status = F.when((F.col("blank_campaigns_delivering") > 0) | (critical > 0), "fail").when(
        (F.col("blank_rows") > 0) | (warn > 0), "warn").otherwise("clean")
    return row.withColumns(missing).select(
        "rows", "impressions", "spend", "creatives",
        F.date_format("window_low", "yyyy-MM-dd").alias("window_start"),
        F.date_format("window_high", "yyyy-MM-dd").alias("window_end"),
        "blank_rows", "blank_empty", "blank_placeholder", "blank_impressions", "blank_spend",
        "blank_impr_pct", "blank_spend_pct",
        *[F.lit(c in prof.columns).alias(k) for k, c in FEATURES.items()],
        "blank_campaigns", "blank_campaigns_delivering", "blank_clients",
        preview.alias("missing_preview_creatives"), "sm_display_size_creatives",
        (F.col("check_rows") + conflict).cast("long").alias("issues"),
        critical.cast("long").alias("critical_issues"), status.alias("status"),
        *[F.col(c).alias(f"perf_{c}") for c in COUNTS], *_NO_TAGS,
        *[F.col(c).alias(f"st_{c}") for c in SIZE_COUNTS], "banner_impressions")


def creative_summary(creative: DataFrame, min_impressions: int = 1) -> DataFrame:
    """One row: totals, blanks and their shares, features, window, issue counts and status, and
    the counts of the performance (perf_), tagging (utm_, null without URLs) and size (st_)
    audits."""
    return summary_of(written_profile(measured(creative)), min_impressions).drop("banner_impressions")
