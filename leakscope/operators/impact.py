"""What applying the recommended blocks would do, and the buyers' watch lists."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.creative import site_domain
from leakscope.functions.ratios import cpm, ctr, money, ratio, total
from leakscope.operators.leak import delivering, leak_by, top_placements, with_key
from leakscope.operators.norms import one_row_total, sums
from leakscope.sources.dimensions import with_buyer


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with a marker for recommended keys.

    Totals and the recommended part then come out of one conditional aggregate instead of two
    aggregates that are joined.
    """
    marks = keys.withColumn("_rec", F.lit(True))
    return rows.join(marks, "match_key", "left").withColumn(
        "_rec", F.coalesce("_rec", F.lit(False))
    )


def _marked_keys(delivery: DataFrame, keys: DataFrame, grain: list[str]) -> DataFrame:
    """Delivery summed per key and grain, marked: one row per placement to count."""
    per = with_key(delivering(delivery)).groupBy("match_key", *grain).agg(
        *sums("impressions", "spend"))
    return _marked(per, keys)


def block_impact(delivery: DataFrame, keys: DataFrame, dim: str) -> DataFrame:
    """Total and recommended-blocked delivery per product or strategy type."""
    if dim == "product":
        delivery = delivery.filter(F.col("product").isin(*K.PLACEMENT_PRODUCTS))
    rows = _marked_keys(delivery.filter(F.col(dim).isNotNull()), keys, [dim])

    def blocked(c):
        return F.coalesce(F.sum(F.when(F.col("_rec"), F.col(c))), F.lit(0))

    g = rows.groupBy(dim).agg(
        total("impressions", "total_impr"), total("spend", "total_spend"),
        F.count("match_key").alias("total_placements"),
        blocked("impressions").alias("blocked_impr"), blocked("spend").alias("blocked_spend"),
        F.count_if("_rec").alias("blocked_placements"),
    )
    share = ratio("blocked_impr", "total_impr")
    return g.select(
        dim, "total_impr", money("total_spend").alias("total_spend"), "total_placements",
        "blocked_impr", money("blocked_spend").alias("blocked_spend"), "blocked_placements",
        share.alias("pct_impr_blocked"),
        ratio("blocked_spend", "total_spend").alias("pct_spend_blocked"),
        cpm("total_spend", "total_impr").alias("cpm"), (share >= 0.5).alias("hot"),
    )


AFTER_GRAINS = {
    "partner": ["business_unit"], "client": ["client", "product"], "strategy": ["strategy_name"]}


def after_recs(
    delivery: DataFrame, keys: DataFrame, names: Iterable[str] = tuple(AFTER_GRAINS)
) -> DataFrame:
    """Click rate without the recommended placements, and their share, for all named grains.

    (grain, the dimensions of these grains, ctr_after_recs, pct_impr_on_recs): a row has the
    dimensions of its grain, the others are null; delivery without one of them is left out of the
    grain. Delivery is read once and summed per key and dimensions in the map tasks: only groups
    are shuffled, marked and folded by grouping sets, whatever size the list of keys has. Fewer
    grains make fewer and shorter groups.
    """
    grains = {name: AFTER_GRAINS[name] for name in names}
    dims = [d for grain in grains.values() for d in grain]
    per = with_key(delivering(delivery)).groupBy("match_key", *dims).agg(
        *sums("impressions", "clicks"))

    def kept(c):
        return F.sum(F.when(F.col("_rec"), F.lit(0)).otherwise(F.col(c)))

    on_recs = F.coalesce(F.sum(F.when(F.col("_rec"), F.col("impressions"))), F.lit(0))
    folded = _marked(per, keys).groupingSets(
        [[F.col(d) for d in grain] for grain in grains.values()], *[F.col(d) for d in dims]
    ).agg(
        ratio(kept("clicks"), kept("impressions")).alias("ctr_after_recs"),
        ratio(on_recs, F.sum("impressions")).alias("pct_impr_on_recs"),
        *[F.grouping(d).alias(f"_{d}") for d in dims],
    )
    grain = F.coalesce(*[
        F.when(F.col(f"_{grain[0]}") == 0, F.lit(name)) for name, grain in grains.items()])
    named = reduce(lambda a, b: a & b, [(F.col(f"_{d}") == 1) | F.col(d).isNotNull() for d in dims])
    return folded.filter(named).select(
        grain.alias("grain"), *dims, "ctr_after_recs", "pct_impr_on_recs")


def of_grain(after: DataFrame, name: str) -> DataFrame:
    """The rows of one grain of `after_recs`."""
    return after.filter(F.col("grain") == name).select(
        *AFTER_GRAINS[name], "ctr_after_recs", "pct_impr_on_recs")


def partner_watchlist(
    perf: DataFrame, delivery: DataFrame, exposure: DataFrame | None, buyers: DataFrame,
    after: DataFrame,
) -> DataFrame:
    """Flagged partners with block-list exposure, buyer and the effect of the recommendations.

    `after` is the table of `after_recs`. Without a block list the exposure is the partner's leak.
    """
    if exposure is None:
        exposure = leak_by(delivery, "business_unit").select(
            "business_unit", F.col("leaked_impressions").alias("blocked_impr"),
            F.col("placements").alias("blocked_placements"),
        )
    rows = perf.filter("flagged").drop("flagged").join(exposure, "business_unit", "left")
    rows = with_buyer(
        rows.join(of_grain(after, "partner"), "business_unit", "left"), buyers)
    return rows.withColumns(
        {
            "blocked_impr": F.coalesce("blocked_impr", F.lit(0)),
            "blocked_placements": F.coalesce("blocked_placements", F.lit(0)),
            "cpm": cpm("internal_cost"),
        }
    )


def client_watchlist(flags: DataFrame, buyers: DataFrame, after: DataFrame) -> DataFrame:
    return with_buyer(
        flags.join(of_grain(after, "client"), ["client", "product"], "left"), buyers)


def strategy_watchlist(flags: DataFrame, buyers: DataFrame, after: DataFrame) -> DataFrame:
    return with_buyer(flags.join(of_grain(after, "strategy"), "strategy_name", "left"), buyers)


def low_ctr_account_blocked(low_ctr: DataFrame, account_blocks: DataFrame) -> DataFrame:
    """Per-client low-rate sites, and whether the site is also blocked for every account."""
    blocked = account_blocks.select(
        site_domain(F.col("name")).alias("_d")
    ).distinct().withColumn("_hit", F.lit(True))
    joined = low_ctr.join(blocked, site_domain(low_ctr["site"]) == F.col("_d"), "left")
    return joined.withColumns(
        {"acct_blocked": F.coalesce("_hit", F.lit(False)), "cpm": cpm()}
    ).drop("_d", "_hit")


def top_cards(fact: DataFrame, delivery: DataFrame, recs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for the head of a report: window, totals and the recommended part."""
    valid = delivery.filter(F.col("product").isin(*K.PLACEMENT_PRODUCTS))
    placed = one_row_total(
        _marked_keys(valid, keys, []),
        n=F.count("match_key"),
        impr=F.coalesce(F.sum(F.when(F.col("_rec"), F.col("impressions"))), F.lit(0)),
        spend=F.coalesce(F.sum(F.when(F.col("_rec"), F.col("spend"))), F.lit(0)).cast("double"),
    )
    window = one_row_total(delivery, a=F.min("served_date"), b=F.max("served_date"))
    n_recs = recs.agg(F.count("*")).scalar()
    head = fact.agg(
        total("impressions"), ctr(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        money(total(F.col("internal_cost"))).alias("internal_cost"),
    )
    label = F.concat(
        F.date_format(window["a"], "MMM dd"), F.lit(" – "), F.date_format(window["b"], "MMM dd")
    )
    return head.select(
        F.coalesce(label, F.lit("—")).alias("date_range"), "*",
        placed["n"].alias("placements"), n_recs.alias("rec_placements"),
        placed["spend"].alias("rec_spend"), placed["impr"].alias("rec_impr"),
        ratio(placed["impr"], F.col("impressions")).alias("rec_impr_pct"),
    )


def top_placements_flagged(delivery: DataFrame, recs: DataFrame) -> DataFrame:
    """Placements and whether their name is on the recommended list."""
    names = recs.select("name").distinct().withColumn("_hit", F.lit(True))
    top = top_placements(delivery)
    return top.join(names, "name", "left").withColumn(
        "rec", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


