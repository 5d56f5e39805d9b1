"""Review queue, verdicts, and the merged list of recommended blocks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.creative import site_domain
from leakscope.functions.names import category_flag, is_streaming_platform
from leakscope.functions.ratios import cpm, ctr, total
from leakscope.functions.text import fold, text_in
from leakscope.operators.candidates import BLOCK_COLUMNS
from leakscope.operators.ranking import numbered

MERGED_COLUMNS = [c for c in BLOCK_COLUMNS if c != "conversions"]


def review_queue(candidates: dict[str, DataFrame], batch_size: int = 50) -> DataFrame:
    """All candidates of each kind, numbered in batches from the largest down.

    Places are exact and are worked out over ranges of the whole order (impressions, then app id
    and name), so any number of candidates with equal impressions spreads over tasks.
    """
    out = None
    for kind, df in candidates.items():
        rows = df.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    order = [F.desc("impressions"), F.col("app_id"), F.col("name")]
    return numbered(out, ["kind"], order, "_at").withColumns(
        {
            "batch": F.floor(F.col("_at") / batch_size).cast("int"),
            "line": (F.col("_at") % batch_size + 1).cast("int"),
        }
    ).drop("_at")


def apply_verdicts(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates that got a verdict (kind, batch, line, category, reason).

    Streaming platforms are never blocked on quality, whatever the verdict says.
    """
    spared = is_streaming_platform(F.col("name")) | is_streaming_platform(F.col("app_id"))
    return queue.join(verdicts, ["kind", "batch", "line"]).filter(~spared).withColumn(
        "ctr", ctr()
    ).select("kind", *BLOCK_COLUMNS)


def merge_blocks(frames: list[DataFrame]) -> DataFrame:
    """Union block lists in priority order and fold repeated placements into one row.

    The first list's row gives the metrics; categories are combined and the other reasons are
    appended. A group keeps one row for each list (the first in order, should a list repeat a
    placement), so its state has a fixed size.
    """
    union = None
    for priority, df in enumerate(frames):
        rows = df.select(F.lit(priority).alias("_p"), *MERGED_COLUMNS)
        union = rows if union is None else union.unionByName(rows)
    key = F.when(
        text_in(F.col("app_id"), K.BLANK_NAMES), F.col("name")
    ).otherwise(F.col("app_id"))
    metrics = [c for c in MERGED_COLUMNS if c not in ("category", "reason")]
    row = F.struct(
        "_p", F.col("category"), F.col("reason"), F.struct(*metrics).alias("m")
    )
    per_list = [F.min(F.when(F.col("_p") == p, row)).alias(f"_r{p}") for p in range(len(frames))]
    g = union.groupBy(key.alias("_key")).agg(*per_list).withColumn(
        "_rows", F.array_compact(F.array(*[f"_r{p}" for p in range(len(frames))])))
    first = F.get("_rows", F.lit(0))
    more = F.slice("_rows", 2, F.size("_rows"))
    categories = F.array_distinct(
        F.concat(
            F.array(first["category"]),
            F.filter(F.transform(more, lambda r: r["category"]), lambda c: c != ""),
        )
    )
    also = F.array_join(
        F.transform(more, lambda r: F.concat(r["category"], F.lit(": "), r["reason"])), " · "
    )
    return g.select(
        *[first["m"][c].alias(c) for c in metrics],
        F.array_join(categories, " + ").alias("category"),
        F.when(F.size("_rows") > 1, F.concat(first["reason"], F.lit(" | Also: "), also))
        .otherwise(first["reason"]).alias("reason"),
    )


def merge_site_blocks(verdict_sites: DataFrame, high_ctr: DataFrame, low_ctr: DataFrame):
    """Priority for metrics: verdicts, then high click rate, then low click rate."""
    return merge_blocks([verdict_sites, high_ctr, low_ctr])


def merge_app_blocks(verdict_apps: DataFrame, auto_apps: DataFrame):
    return merge_blocks([verdict_apps, auto_apps])


def quality_floor(blocks: DataFrame, min_impr: int = 1000) -> DataFrame:
    """Drop tiny placements, except gaming inventory and click-rate findings."""
    exempt = F.coalesce(F.col("category"), F.lit("")).rlike("(?i)gaming|high ctr|low ctr")
    return blocks.filter((F.col("impressions") >= min_impr) | exempt)


def drop_excluded(blocks: DataFrame, kind: str, exclusions: DataFrame) -> DataFrame:
    """Drop placements that a reviewer excluded earlier (one row per excluded `value`)."""
    raw = exclusions.select(fold(F.col("value")).alias("_x")).distinct()
    if kind == "app":
        return blocks.join(raw, fold(blocks["app_id"]) == F.col("_x"), "left_anti")
    domains = exclusions.select(site_domain(F.col("value")).alias("_d")).distinct()
    kept = blocks.join(domains, site_domain(blocks["name"]) == F.col("_d"), "left_anti")
    return kept.join(raw, fold(kept["name"]) == F.col("_x"), "left_anti")


def with_flags(blocks: DataFrame) -> DataFrame:
    """Flag (quality, high or low click rate), the low click-rate marker and CPM."""
    return blocks.withColumns(
        {
            "flag": category_flag(F.col("category")),
            "is_low_ctr_block": F.coalesce(F.col("category"), F.lit(""))
            .contains(K.LOW_CTR_CATEGORY),
            "cpm": cpm(),
        }
    )


def recommended(sites: DataFrame, apps: DataFrame) -> DataFrame:
    """Both lists as one frame with their kind."""
    return sites.withColumn("kind", F.lit("site")).unionByName(
        apps.withColumn("kind", F.lit("app"))
    )


def recommended_by_flag(recs: DataFrame, flag: str) -> DataFrame:
    """All rows whose flag contains the given one."""
    return recs.filter(F.col("flag").contains(flag))


def filter_clauses(recs: DataFrame) -> DataFrame:
    """One filter clause per recommended placement.

    The filter text of a kind is its clauses by falling impressions joined with blanks, and the
    comma list its values; one row per clause keeps both free of a size limit.
    """
    value = F.btrim(
        F.replace(F.when(F.col("kind") == "app", F.col("app_id")).otherwise(F.col("name")),
                  F.lit('"'), F.lit(""))
    )
    field = F.when(F.col("kind") == "app", K.FILTER_FIELDS["app"]).otherwise(
        K.FILTER_FIELDS["site"]
    )
    clauses = recs.select("kind", "impressions", value.alias("value"), field.alias("_field"))
    return clauses.filter(F.col("value") != "").select(
        "kind", "value", "impressions",
        F.concat(F.lit("OR {"), F.col("_field"), F.lit('}="'), F.col("value"), F.lit('"'))
        .alias("clause"),
    )


def recommendation_totals(recs: DataFrame) -> DataFrame:
    return recs.groupBy("kind").agg(
        F.count("*").alias("placements"), total("impressions"), total("clicks")
    )


def recommended_keys(recs: DataFrame) -> DataFrame:
    """Distinct delivery keys of all recommendations."""
    key = F.when(F.col("kind") == "app", fold(F.col("app_id"))).otherwise(fold(F.col("name")))
    return recs.select(key.alias("match_key")).filter(
        ~text_in(F.col("match_key"), [""])
    ).distinct()
