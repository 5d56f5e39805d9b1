"""Physical plans: pruned scans, pushed filters, joins that can fall back to a shuffle."""

import re

from conftest import SMALL

from leakscope.operators import blocklist as B
from leakscope.operators import leak as L
from leakscope.operators import performance as V
from leakscope.plans import facts
from leakscope.plans.delivery_queries import key_blocklist
from leakscope.sources.exports import filter_date_range
from leakscope.sources.pooling import newest_rows

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_scan_reads_only_what_the_table_needs(spark):
    text = plan(V.perf_by_strategy(facts.performance(spark, SMALL)))
    allowed = {"strategy_type", "impressions", "clicks", "conversions", "view_throughs", "spend"}
    assert all(cols <= allowed for cols in read_columns(text))


def test_filters_reach_the_scan(spark):
    text = plan(L.leak_by_type(facts.delivery(spark, SMALL)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(impressions,0\)", text)


def test_date_filter_passes_below_pooling(spark):
    rows = facts.delivery(spark, SMALL).select("client", "served_date", "impressions")
    pooled = newest_rows(rows, ["client", "served_date"], ["impressions"])
    kept = filter_date_range(pooled, "1998-01-01", "1998-02-01", "served_date")
    assert re.search(r"PushedFilters: \[[^\]]*served_date", plan(kept))


def test_figures_of_a_feed_read_it_twice(spark):
    """Ends of the window and sums; every figure then comes from the profile."""
    from leakscope.operators.creative_alert import alert_of
    from leakscope.operators.creative_profile import measured, profile, summary_of, written_profile

    creative = facts.creative(spark, SMALL)
    assert plan(profile(measured(creative))).count("FileScan parquet") == 2
    prof = written_profile(measured(creative))
    text = plan(alert_of(prof, summary_of(prof)))
    assert set(re.findall(r"Location: \w+ ?\(1 paths\)\[[^\]]*/([a-z-]+?)-[0-9a-f]{4,}", text)) <= {
        "creative-profile"}


def test_recommended_keys_meet_groups_not_rows(spark):
    """Without broadcasts no row of delivery is shuffled, and three grains take one scan."""
    from leakscope.operators.impact import after_recs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(5).selectExpr("cast(id as string) AS match_key")
        text = plan(after_recs(facts.delivery(spark, SMALL), keys))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("FileScan parquet") == 1
    scan = text.splitlines().index(next(x for x in text.splitlines() if "FileScan parquet" in x))
    below = [x for x in text.splitlines()[:scan] if "Exchange" in x or "HashAggregate" in x]
    assert "partial_sum" in below[-1]  # the aggregate stands between the scan and any exchange


def test_staged_facts_have_several_files(spark):
    """A fact is rebalanced as it is written, whatever the row groups of its source."""
    assert len(facts.delivery(spark, "/root/testdata/sf0.01").inputFiles()) > 1


def test_no_forced_broadcast(spark):
    """With automatic broadcasts off, every join falls back to a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = facts.delivery(spark, SMALL)
        df = B.blocklist_check(d, key_blocklist(spark, SMALL))
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
