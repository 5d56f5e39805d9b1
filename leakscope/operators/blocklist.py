"""Delivery against the master block list.

`blocklist` is one row per key (`sources.dimensions.blocklist_by_key`), so joining it never
multiplies delivery rows; product scope and dates are column expressions on the joined row.

The join comes first: a list that people keep is small, Spark sees that from its size and
broadcasts it, and only listed delivery, already summed in the map tasks, is shuffled. There is no
broadcast hint, so a list that outgrows the threshold joins by shuffle with skewed keys split.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions import names as N
from leakscope.functions.ratios import cpm, ctr, money, total
from leakscope.functions.text import date_or, fold, strip, text_in
from leakscope.operators.leak import delivering, with_key
from leakscope.operators.norms import sums
from leakscope.sources.dimensions import blocked_since

POST = ["post_impr", "post_spend"]


def listed(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Delivery on listed keys with the day its product was blocked."""
    rows = with_key(delivering(delivery)).join(blocklist, "match_key")
    return rows.withColumn("blocked_date", blocked_since(F.col("product")))


def on_blocklist(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Delivery on listed keys with the day its product was blocked and its post-block part.

    Post-block means served strictly after the first day the product was blocked.
    """
    rows = listed(delivery, blocklist)
    after = F.col("served_date") > F.col("blocked_date")
    return rows.withColumns(
        {
            "post_impr": F.when(after, F.col("impressions")).otherwise(F.lit(0)),
            "post_spend": F.when(after, F.col("spend")).otherwise(F.lit(0)),
        }
    )


def blocklist_check(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Totals per listed key, and what it delivered after it was blocked for the product."""
    rows = on_blocklist(delivery, blocklist).withColumn("listed_name", _listed_name())
    g = rows.groupBy("match_key", "listed_name", "placement_type", "lists", "date_added").agg(
        F.bit_or(_product_bit()).alias("_on"),
        *sums("impressions", "spend", *POST), F.max("served_date").alias("last"),
    ).groupBy("match_key", "lists", "date_added").agg(
        F.min("listed_name").alias("name"), F.min("placement_type").alias("placement_type"),
        _listed_products().alias("products"),
        *sums("impressions", "spend", *POST), F.max("last").alias("last"),
    )
    return g.select(
        "match_key", "name", "placement_type", "products", "impressions",
        money("spend").alias("spend"), "post_impr", money("post_spend").alias("post_spend"),
        "lists", (F.col("post_impr") > 0).alias("leaking"),
        date_or(F.col("last"), "—").alias("last_served"),
        date_or(F.col("date_added"), "—").alias("date_added"),
        cpm().alias("cpm"),
    )


def _listed_name():
    return N.listed_name(F.col("placement_type"), F.col("placement"), F.col("app_id"))


# Known products of a group are one number, as a column for each would be shuffled with every row.
PRODUCT_BITS = {p: 1 << i for i, p in enumerate(sorted(K.PLACEMENT_PRODUCTS))}


def _product_bit():
    bit = F.lit(0)
    for p, b in PRODUCT_BITS.items():
        bit = F.when(F.col("product") == p, b).otherwise(bit)
    return bit


def _listed_products():
    on = F.bit_or("_on")
    return F.concat_ws(
        ", ", *[F.when(on.bitwiseAND(F.lit(b)) != 0, F.lit(p)) for p, b in PRODUCT_BITS.items()])


CLIENT_GRAIN = ["business_unit", "client", "strategy_name", "campaign_id"]


def _client_rows(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    named = delivery.filter(~text_in(F.col("client"), K.BLANK_DIMENSIONS))
    return on_blocklist(named, blocklist)


def clients_on_blocked(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Partner x client x strategy x campaign rows that served listed placements.

    Summing per key first makes every distinct count a plain count. The placements themselves
    are the rows of `blocked_placements_by_client`, since a list per client has no size bound.
    """
    rows = _client_rows(delivery, blocklist)
    sentinel = F.col("blocked_date") <= F.lit("1971-01-01").cast("date")
    per_key = rows.groupBy(*CLIENT_GRAIN, "match_key").agg(
        F.bit_or(_product_bit()).alias("_on"),
        F.bool_or(F.col("placement_type") == "site").alias("_site"),
        F.bool_or(F.col("placement_type") == "app").alias("_app"),
        F.bool_or(N.is_combined_dsp(F.col("dsp"))).alias("ttddv"),
        F.min(F.when(~sentinel, F.col("blocked_date"))).alias("added"),
        F.max("served_date").alias("last"),
        *sums("impressions", "clicks", "spend", *POST),
    )
    g = per_key.groupBy(*CLIENT_GRAIN).agg(
        _listed_products().alias("products"),
        F.count("*").alias("n_sites"), F.count_if("_site").alias("n_site"),
        F.count_if("_app").alias("n_app"), F.bool_or("ttddv").alias("ttddv"),
        F.min("added").alias("added"), F.max("last").alias("last"),
        *sums("impressions", "clicks", "spend", *POST),
    )
    return g.select(
        *CLIENT_GRAIN[:3], F.col("campaign_id").alias("strategy_id"),
        F.when(F.col("ttddv"), "TTD/DV360").otherwise("").alias("dsp"), "products",
        "n_sites", "n_site", "n_app", date_or(F.col("added"), "—").alias("date_added"),
        date_or(F.col("last"), "—").alias("last_served"), "impressions", "clicks",
        ctr().alias("ctr"), money("spend").alias("spend"), "post_impr",
        money("post_spend").alias("post_spend"), cpm().alias("cpm"),
    )


def blocked_placements_by_client(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """The listed placements of every row of `clients_on_blocked`, one row each, whole."""
    rows = _client_rows(delivery, blocklist).withColumn("site", strip(_listed_name()))
    return rows.filter(F.col("site") != "").select(
        *CLIENT_GRAIN[:3], F.col("campaign_id").alias("strategy_id"), "site"
    ).distinct()


def blocklist_exposure_by_bu(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Delivery per partner on keys that are blocked for the product it ran on."""
    rows = listed(delivery, blocklist)
    exposed = rows.filter(
        F.col("blocked_date").isNotNull() & F.col("business_unit").isNotNull()
    )
    per_key = exposed.groupBy("business_unit", "match_key").agg(total("impressions"))
    return per_key.groupBy("business_unit").agg(
        total("impressions", "blocked_impr"), F.count("*").alias("blocked_placements")
    )


def blocklist_check_summary(delivery: DataFrame, blocklist: DataFrame) -> DataFrame:
    rows = on_blocklist(delivery, blocklist)
    per_key = rows.groupBy("match_key").agg(*sums(*POST))
    leaking = F.col("post_impr") > 0
    return per_key.agg(
        F.count("*").alias("matched"), F.count_if(leaking).alias("leaking_count"),
        money(F.coalesce(F.sum(F.when(leaking, F.col("post_spend"))), F.lit(0)))
        .alias("leaking_spend"),
    )


def audit_flags(delivery: DataFrame, blocklist: DataFrame, app_candidates: DataFrame) -> DataFrame:
    """One row: conversions seen, apps identified by id, campaign ids missing everywhere."""
    has_id = app_candidates.agg(
        F.coalesce(F.bool_or(F.col("app_id") != F.col("name")), F.lit(False))
    ).scalar()
    rows = _client_rows(delivery, blocklist)
    no_id = rows.agg(
        F.coalesce(F.bool_and(text_in(F.col("campaign_id"), ["", "nan", "none"])), F.lit(True))
    ).scalar()
    return delivery.agg(
        F.coalesce(F.bool_or("has_conversions"), F.lit(False)).alias("has_conversions")
    ).select("*", has_id.alias("has_app_id"), no_id.alias("no_strategy_id"))


def blocklist_sheet_audit(blocklist_dim: DataFrame, delivery: DataFrame) -> DataFrame:
    """Block-list values that cannot match delivery as they are, with a suggested fix.

    Each value asks for its own key, the id inside a composite, and three repaired spellings;
    the at most five keys of a value are looked up in one join against the delivery's keys.
    """
    entries = blocklist_dim.groupBy("match_key").agg(
        F.min("value").alias("value"),
        F.concat_ws(", ", *[
            F.when(F.bool_or(F.col("tab") == t), F.lit(t)) for t in sorted(K.BLOCK_TABS)
        ]).alias("tabs"),
    )
    inner = strip(F.regexp_extract(strip(F.col("value")), K.COMPOSITE_ID, 2))
    composite = strip(F.col("value")).rlike(K.COMPOSITE_ID) & (
        inner.contains(".") | inner.rlike(K.STORE_ID)
    )
    key = F.col("match_key")
    lookups = {
        "exact": key,
        "inner": F.when(composite, F.lower(inner)),
        "spaces": F.replace(key, F.lit(" "), F.lit("")),
        "leading": F.ltrim(key, F.lit(", ")),
        "www": F.regexp_replace(key, r"^www\.", ""),
    }
    asked = entries.withColumn(
        "_ask",
        F.explode(F.array(*[
            F.struct(F.lit(kind).alias("kind"), c.alias("key")) for kind, c in lookups.items()
        ])),
    )
    valid = delivering(delivery).filter(F.col("product").isin(*K.PLACEMENT_PRODUCTS))
    seen = with_key(valid).groupBy(F.col("match_key").alias("_seen")).agg(
        F.bool_or(F.col("placement_type") == "site").alias("_as_site")
    )
    hits = asked.join(seen, F.col("_ask.key") == F.col("_seen"), "left")

    def hit(kind):
        return F.coalesce(
            F.bool_or((F.col("_ask.kind") == kind) & F.col("_seen").isNotNull()), F.lit(False)
        ).alias(f"hit_{kind}")

    found = hits.groupBy("match_key", "value", "tabs").agg(
        *[hit(kind) for kind in lookups],
        F.coalesce(F.bool_or((F.col("_ask.kind") == "exact") & F.col("_as_site")), F.lit(False))
        .alias("as_site"),
    )
    repaired = reduce(
        lambda later, kind: F.when(
            F.col(f"hit_{kind}") & (lookups[kind] != key), lookups[kind]
        ).otherwise(later),
        ["www", "leading", "spaces"],
        F.lit(None).cast("string"),
    )
    misfiled = key.isin(*K.APP_DOMAINS) & F.col("as_site")
    live = F.when(
        F.col("hit_inner"), " — the bare id has live delivery this period"
    ).otherwise("")
    spelled = ~F.col("hit_exact") & F.col("_repaired").isNotNull()
    issue = (
        F.when(composite, "Composite value").when(spelled, "Value mismatch")
        .when(misfiled, "App inventory in domain form")
    )
    suggestion = (
        F.when(composite, F.concat(F.lit('Replace with "'), inner, F.lit('"'), live))
        .when(spelled, F.concat(
            F.lit('Delivery matches "'), F.col("_repaired"), F.lit('" — update the value')))
        .when(misfiled, "This is app inventory (AOL Desktop App) — verify it sits on "
                        "app-type blocking")
    )
    return found.withColumn("_repaired", repaired).withColumns(
        {"issue": issue, "suggestion": suggestion}
    ).filter(F.col("issue").isNotNull()).select("value", "tabs", "issue", "suggestion")
