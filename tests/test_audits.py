"""Rules of the audits as invariants and on hand-written delivery."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakscope.operators import blocklist as B
from leakscope.operators import candidates as C
from leakscope.operators import creative_performance as P
from leakscope.operators import creative_profile as S
from leakscope.operators import creative_quality as Q
from leakscope.operators import creative_sizes as Z
from leakscope.operators import creative_utm as U
from leakscope.operators import exchange as E
from leakscope.operators import leak as L
from leakscope.operators import performance as V
from leakscope.operators import recommend as R
from leakscope.operators.creative_alert import creative_alert_rows
from leakscope.plans import facts
from leakscope.sources.dimensions import blocklist_by_key

DAY = dt.date(2026, 5, 1)


def test_products_of_low_ctr_sites(spark):
    given = [("a.com", "Display"), ("a.com", "Line 7"), ("b.com", "Line 7"), ("b.com", "Line 8")]
    d = spark.createDataFrame(
        [line(placement=p, product=x, impressions=9000, clicks=0) for p, x in given], DELIVERY)
    flagged = C.auto_low_ctr_site_blocks(d)
    assert {r["name"] for r in flagged.collect()} == {"a.com", "b.com"}
    rows = C.low_ctr_site_products(d, flagged).collect()
    assert sorted((r["name"], r["product"]) for r in rows) == sorted(given)
    assert {(r["name"], r["other_products"]) for r in rows} == {("a.com", 1), ("b.com", 2)}
    assert {r["product"] for r in rows if r["is_known"]} == {"Display"}


DELIVERY = ("served_date date, business_unit string, client string, product string, "
            "strategy_type string, strategy_name string, campaign_id string, "
            "placement_type string, placement string, app_id string, dsp string, "
            "raw_value string, impressions long, clicks long, conversions long, "
            "spend decimal(18,2), is_block boolean, is_unresolved boolean, "
            "has_conversions boolean")


def line(**given):
    row = dict(
        served_date=DAY, business_unit="BU", client="C", product="Display", strategy_type="T",
        strategy_name="S", campaign_id="1", placement_type="site", placement="a.com",
        app_id="a.com", dsp="", raw_value="", impressions=1000, clicks=10, conversions=0,
        spend=5, is_block=False, is_unresolved=False, has_conversions=True) | given
    row["spend"] = __import__("decimal").Decimal(row["spend"])
    return tuple(row.values())


def delivery(spark, *lines):
    return spark.createDataFrame([line(**x) for x in lines], DELIVERY)


def blocklist(spark, *items):
    dim = spark.createDataFrame(list(items), "match_key string, tab string, date_added date")
    return blocklist_by_key(dim.withColumn("value", F.col("match_key")))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_block_scope_and_dates(spark):
    d = delivery(
        spark, dict(placement="ctv.com"), dict(placement="ctv.com", product="CTV"),
        dict(placement="audio.com", product="Online Audio"), dict(placement="all.com", served_date=None),
        dict(placement="same.com"), dict(placement="free.com"))
    bl = blocklist(
        spark, ("ctv.com", "CTV", dt.date(2026, 1, 1)), ("audio.com", "Audio", None),
        ("all.com", "All Products", None), ("same.com", "All Products", DAY))
    got = by(B.blocklist_check(d, bl), "match_key")
    # On the CTV list, only the CTV delivery came after the block.
    assert (got["ctv.com"].impressions, got["ctv.com"].post_impr) == (2000, 1000)
    # A blank date counts as blocked long ago, and shows as unknown.
    assert got["audio.com"].leaking and got["audio.com"].date_added == "—"
    # Neither a row without a date nor one served on the day of the block leaks.
    assert not got["all.com"].leaking and not got["same.com"].leaking
    assert "free.com" not in got
    exposure = B.blocklist_exposure_by_bu(d, bl).first()
    assert (exposure.blocked_impr, exposure.blocked_placements) == (4000, 4)
    clients = B.clients_on_blocked(d, bl).first()
    assert (clients.n_sites, clients.n_site, clients.n_app) == (4, 4, 0)
    assert clients.date_added == "2026-01-01"


def test_candidates_leave_handled_placements_out(spark):
    d = delivery(
        spark, dict(placement="flagged.com", is_block=True), dict(placement="flagged.com"),
        dict(placement="half.com"), dict(placement="half.com", product="CTV"),
        dict(placement="whole.com", product="CTV"), dict(placement="odd.com", product="Leaked"),
        dict(placement="new.com"))
    bl = blocklist(spark, ("half.com", "CTV", None), ("whole.com", "CTV", None),
                   ("odd.com", "Audio", None))
    got = by(C.block_candidates(d, "site", bl), "name")
    assert set(got) == {"half.com", "new.com"}
    assert got["half.com"].products == "CTV, Display"


def test_apps_with_one_name_stay_apart(spark):
    apps = [dict(placement_type="app", placement="Contacts - Android", app_id=f"com.dev{i}.contacts",
                 raw_value=f"r{i}") for i in range(4)]
    apps += [dict(placement_type="app", placement="Hulu - Roku", app_id=f"{i}2345678") for i in range(4)]
    apps += [dict(placement_type="app", placement="Pluto TV", app_id=f"com.p{i}.tv") for i in range(4)]
    apps += [dict(placement_type="app", placement="Contacts", app_id="com.tiny.contacts", impressions=50)]
    cands = C.block_candidates(delivery(spark, *apps), "app")
    assert cands.count() == 13
    clones = by(C.clone_families(cands), "app_id")
    # Same family with and without the platform suffix; tiny members count but are not listed.
    assert set(clones) == {f"com.dev{i}.contacts" for i in range(4)}
    assert clones["com.dev0.contacts"].developers == 5
    auto = by(C.auto_app_blocks(cands), "app_id")
    assert {r.category for r in auto.values()} == {"Clone-family app"} and len(auto) == 4
    merged = R.merge_app_blocks(C.auto_app_blocks(cands).limit(0), C.auto_app_blocks(cands))
    assert merged.count() == 4


def test_merge_keeps_priority(spark):
    schema = "name string, app_id string, impressions long, category string, reason string"

    def block(*items):
        df = spark.createDataFrame(list(items), schema)
        extra = {"products": F.lit(""), "clicks": F.lit(1), "ctr": F.lit(0.1), "spend": F.lit(1.0),
                 "ttddv": F.lit(False), "raw_value": F.lit("")}
        return df.withColumns(extra)

    first = block(("a", "a", 10, "MFA", "r1"))
    high = block(("a", "a", 20, "High CTR", "r2"), ("b", "", 5, "High CTR", "r3"))
    low = block(("a", "a", 30, "MFA", "r4"))
    got = by(R.merge_site_blocks(first, high, low), "name")
    assert got["a"].category == "MFA + High CTR" and got["a"].impressions == 10
    assert got["a"].reason == "r1 | Also: High CTR: r2 · MFA: r4"
    assert got["b"].reason == "r3"


def test_leak_window(spark):
    d = delivery(
        spark, dict(is_block=True, placement="x", served_date=DAY - dt.timedelta(days=1)),
        dict(is_block=True, placement="y", served_date=DAY - dt.timedelta(days=2)),
        dict(is_block=True, placement="z", served_date=None), dict(is_block=True, impressions=0),
        dict(placement="last"))
    got = by(L.leak_offenders(d), "placement")
    assert (got["x"].still_active, got["y"].still_active, got["z"].still_active) == (True, False, None)
    assert got["z"].last_served == "(no date)"
    s = L.leak_summary(d).first()
    assert (s.leaked_rows, s.leaked_placements, s.active_placements) == (3, 3, 1)


def test_null_dimensions(spark):
    d = delivery(spark, dict(client=None, is_block=True), dict(client="C", is_block=True))
    assert {r.client for r in L.leak_by(d, "client").collect()} == {None, "C"}
    assert {r.client for r in L.watchlist_source(d).collect()} == {None, "C"}


@pytest.mark.parametrize("kind", ["sites", "exchanges"])
def test_converters_are_never_flagged(spark, small, kind):
    if kind == "sites":
        df = C.low_ctr_sites_by_client(facts.delivery(spark, small))
    else:
        df = E.exchange_flags(facts.exchange(spark, small))
    assert df.count() > 0 and df.filter("conv_rate >= 0.0003").count() == 0


def test_shares_add_up(spark, small):
    d = facts.delivery(spark, small)
    assert L.top_placements(d).agg(F.sum("pct_impr")).first()[0] == pytest.approx(1)
    products = V.perf_by_product(facts.performance(spark, small))
    assert products.agg(F.sum("pct_of_spend")).first()[0] == pytest.approx(1)
    sizes = Z.perf_by_size(facts.creative(spark, small))
    assert sizes.agg(F.sum("pct_of_impr")).first()[0] == pytest.approx(1)


def test_rollups_agree(spark, small):
    d = facts.delivery(spark, small)
    at_once = L.leak_rollups(d).filter("dimension = 'client'").drop("dimension")
    alone = L.leak_by(d, "client").withColumnRenamed("client", "value")
    assert at_once.select(alone.columns).exceptAll(alone).count() == 0
    assert at_once.count() == alone.count()


def test_tag_slices_partition_the_library(spark, small):
    c = facts.creative(spark, small)
    per = U.utm_per_creative(c)
    n = {r.slice: r.creatives for r in U.utm_summary(c).collect()}
    assert n["tagged"] + n["untagged"] + n["no_url"] == per.count()
    assert n["fully_tagged"] + n["partially_tagged"] == n["tagged"]
    assert per.select("creative_key").distinct().count() == per.count()


FEED = ("date date, business_unit string, client string, product string, campaign string, "
        "campaign_id string, creative_id string, creative string, click_url string, "
        "impressions long, clicks long, spend double, conversions long")


def feed(spark, *items):
    base = dict(date=DAY, business_unit="B", client="C", product="Display", campaign="P",
                campaign_id="1", creative_id="7", creative="Summer sale", click_url="https://a",
                impressions=1000, clicks=3, spend=10.0, conversions=0)
    return spark.createDataFrame([tuple((base | x).values()) for x in items], FEED)


def test_checks_without_optional_columns(spark):
    f = feed(spark, dict(creative=None), dict(creative="Promo.mp4")).drop("click_url", "creative_id")
    got = by(Q.creative_checks(f), "key")
    assert "no_utm" not in got and "id_name_conflict" not in got
    assert got["blank_creative"].rows == 1 and got["format_mismatch"].rows == 1
    assert S.creative_summary(f).first().status == "fail"


def test_clean_feed_raises_no_alert(spark):
    f = feed(spark, dict(), dict(date=DAY + dt.timedelta(days=1))).withColumns(
        {q: F.lit(0) for q in ("q25", "q50", "q75", "q100")})
    assert S.creative_summary(f).first().critical_issues == 0
    assert creative_alert_rows(f).count() == 0


def test_coverage_text(spark):
    f = feed(spark, dict(creative=" "), dict(), dict(campaign_id="2", creative="n/a"))
    got = by(Q.blank_campaigns(f), "campaign_id")
    assert got["1"].coverage == "1 of 2 rows" and got["2"].coverage == "every row"
    assert (got["1"].issue, got["2"].issue) == ("empty", "placeholder")


def test_fatigue_halves(spark):
    def days(n, late_clicks, product="Display"):
        return [dict(date=DAY + dt.timedelta(days=i), impressions=10000, product=product,
                     clicks=100 if i <= (n - 1) / 2 else late_clicks) for i in range(n)]

    tired = P.creative_fatigue(feed(spark, *days(5, 10))).first()
    # Days 0 to 2 are the early half of a four-day span, the middle day included.
    assert (tired.ctr_early, tired.ctr_late) == (0.01, 0.001)
    assert P.creative_fatigue(feed(spark, *days(3, 10))).count() == 0
    assert P.creative_fatigue(feed(spark, *days(5, 10, "CTV"))).count() == 0
    undated = P.creative_fatigue(feed(spark, *days(5, 100), dict(date=None, impressions=80000, clicks=0)))
    assert undated.first().ctr_late == pytest.approx(0.002)


def test_url_of_most_impressions_wins(spark):
    f = feed(
        spark, dict(click_url=None, impressions=5000),
        dict(click_url="https://a/?utm_source=1", impressions=10),
        dict(campaign_id="2", click_url="https://b", impressions=9000))
    placements = by(U.utm_by_placement(f), "campaign_id")
    assert placements["1"].url == "https://a/?utm_source=1" and placements["1"].urls_seen == 1
    verdict = U.utm_per_creative(f).first()
    assert (verdict.url, verdict.status, verdict.distinct_urls) == ("https://b", "no UTM codes", 2)


def test_null_campaigns_join_as_equal(spark):
    f = feed(
        spark, dict(campaign=None, impressions=90000), dict(campaign=None, creative="Other one"),
        dict(campaign=None, creative="Third one"))
    assert P.dominant_creatives(f).first().creative == "Summer sale"


def test_blank_ids_do_not_conflict(spark):
    f = feed(spark, dict(creative_id=""), dict(creative_id="", creative="Other name"),
             dict(creative_id="9"), dict(creative_id="9", creative="Renamed asset"))
    assert [r.creative_id for r in Q.id_name_conflict(f).collect()] == ["9"]


def test_excluded_variants(spark):
    blocks = spark.createDataFrame([("tmz.com", "tmz.com"), ("b.com", "b.com")], "name string, app_id string")
    excluded = spark.createDataFrame([("https://www.TMZ.com/foo",)], "value string")
    assert [r.name for r in R.drop_excluded(blocks, "site", excluded).collect()] == ["b.com"]
    assert R.drop_excluded(blocks, "app", excluded).count() == 2


def test_review_numbers_every_candidate(spark):
    from leakscope.operators.recommend import review_queue

    df = spark.range(1000).selectExpr(
        "concat('n', id) AS name", "concat('a', id) AS app_id", "(id * 7919) % 311 AS impressions")
    got = review_queue({"site": df, "app": df.filter("id < 3")}).collect()
    for kind, n in (("site", 1000), ("app", 3)):
        rows = sorted((r for r in got if r.kind == kind), key=lambda r: (r.batch, r.line))
        assert [(r.batch, r.line) for r in rows] == [(i // 50, i % 50 + 1) for i in range(n)]
        order = [(-r.impressions, r.app_id, r.name) for r in rows]
        assert order == sorted(order)


def test_ties_of_a_queue_spread_over_tasks(spark):
    """A million candidates with equal impressions: exact places, no task with a large share."""
    from leakscope.operators.ranking import numbered, placed

    df = spark.range(1_000_000).selectExpr(
        "cast(id % 2 as string) AS kind", "7L AS impressions",
        "concat('a', lpad(cast((id * 7919) % 1000003 as string), 7, '0')) AS app_id")
    order = [F.desc("impressions"), F.col("app_id")]
    sizes = [r[0] for r in placed(df, ["kind"], order).groupBy("_part").count().select(
        "count").collect()]
    assert len(sizes) > 2 and max(sizes) < 1_000_000 / 2
    got = numbered(df, ["kind"], order, "place")
    first = got.groupBy("kind").agg(
        F.count_distinct("place").alias("n"), F.min("place").alias("a"), F.max("place").alias("z"))
    assert {tuple(r)[1:] for r in first.collect()} == {(500_000, 0, 499_999)}
    spread = got.filter("place % 50000 = 0").orderBy("kind", "place").collect()
    assert [r.app_id for r in spread if r.kind == "0"] == sorted(
        r.app_id for r in spread if r.kind == "0")
    some = spread[5]
    assert got.filter((F.col("kind") == some.kind) & (F.col("app_id") < some.app_id)
                      ).count() == some.place


def test_null_groups_are_numbered(spark):
    from leakscope.operators.ranking import numbered

    df = spark.createDataFrame([(None, 3), (None, 1), ("x", 2)], "g string, n int")
    got = numbered(df, ["g"], [F.desc("n")], "place").collect()
    assert sorted((str(r.g), r.n, r.place) for r in got) == [
        ("None", 1, 1), ("None", 3, 0), ("x", 2, 0)]


def test_figures_of_a_feed_without_urls_or_quartiles(spark):
    f = feed(spark, dict(), dict(creative="Other one", date=None)).drop("click_url")
    row = S.creative_summary(f).first()
    assert row.utm_creatives is None and row.st_completion_creatives == 0
    assert (row.perf_creatives, row.perf_creative_campaign_pairs, row.st_sizes) == (2, 2, 1)
    empty = S.creative_summary(f.limit(0)).first()
    assert empty["rows"] == 0 and empty.status == "clean" and empty.perf_fatigue == 0
    assert S.performance_counts(f.limit(0)).first().winners == 0


def test_app_inventory_on_a_domain_list(spark):
    """A listed app domain that is served as a site is asked to be checked; spelled wrongly, mended."""
    from leakscope.functions import constants as K

    domain = sorted(K.APP_DOMAINS)[0]
    d = delivery(spark, dict(placement=domain), dict(placement="good.com"))
    dim = spark.createDataFrame(
        [(domain, "CTV", None), ("www.good.com", "Audio", None), ("other.com", "CTV", None)],
        "match_key string, tab string, date_added date").withColumn("value", F.col("match_key"))
    got = by(B.blocklist_sheet_audit(dim, d), "value")
    assert set(got) == {domain, "www.good.com"}
    assert got[domain].issue == "App inventory in domain form"
    assert (got["www.good.com"].issue, got["www.good.com"].tabs) == ("Value mismatch", "Audio")


def test_partners_above_the_default_tiers(spark):
    from leakscope.operators import impact as I

    d = delivery(
        spark, dict(business_unit="hot", impressions=20000, clicks=600),
        dict(business_unit="warm", impressions=20000, clicks=400),
        dict(business_unit="big", impressions=40000, clicks=500, is_block=True),
        dict(business_unit="cold", impressions=40000, clicks=100, placement="rec.com"))
    fact = d.withColumn("internal_cost", F.col("spend")).withColumn("view_throughs", F.lit(0))
    perf = V.perf_by_business_unit(fact)
    assert {r.business_unit for r in perf.filter("flagged").collect()} == {"hot", "big"}
    keys = spark.createDataFrame([("a.com",)], "match_key string")
    buyers = spark.createDataFrame([("HOT", "Ann")], "partner string, buyer string")
    after = I.after_recs(d, keys)
    got = by(I.partner_watchlist(perf, d, None, buyers, after), "business_unit")
    # without a block list the exposure is the leak
    assert (got["big"].blocked_impr, got["big"].blocked_placements) == (40000, 1)
    assert got["hot"].blocked_impr == 0 and got["hot"].buyer == "Ann" and got["big"].buyer == ""
    assert got["hot"].pct_impr_on_recs == 1.0 and got["hot"].ctr_after_recs == 0.0
    assert {r.grain for r in after.collect()} == {"partner", "client", "strategy"}
    cold = after.filter("grain = 'partner' and business_unit = 'cold'").first()
    assert (cold.ctr_after_recs, cold.pct_impr_on_recs) == (0.0025, 0.0)


def test_grains_leave_out_rows_without_their_dimension(spark):
    from leakscope.operators import impact as I

    d = delivery(spark, dict(product=None), dict(client="D", strategy_name=None))
    keys = spark.createDataFrame([("a.com",)], "match_key string")
    got = {(r.grain, r.business_unit, r.client, r.product, r.strategy_name)
           for r in I.after_recs(d, keys).collect()}
    assert got == {("partner", "BU", None, None, None), ("client", None, "D", "Display", None),
                   ("strategy", None, None, None, "S")}


def test_small_blocks_fall_below_the_default_floor(spark):
    blocks = spark.createDataFrame(
        [("a", 999, "MFA"), ("b", 1000, "MFA"), ("c", 1, "Gaming app"), ("d", 1, "High CTR"),
         ("e", 1, None)], "name string, impressions long, category string")
    assert {r.name for r in R.quality_floor(blocks).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("size,family", [
    ("1601x901", "landscape/video"), ("401x1001", "vertical/story"), ("500x400", "square-ish"),
    ("300x250", "IAB display"), ("x", "unknown"), ("(not specified)", "unknown")])
def test_size_families(spark, size, family):
    from leakscope.functions.creative import size_family

    assert spark.range(1).select(size_family(F.lit(size))).first()[0] == family
