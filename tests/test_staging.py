"""How the shared facts are built: few shuffles of narrow rows, and no more columns than needed."""

import datetime
import re
import time

import pytest
from conftest import SMALL

from leakscope import lineage
from leakscope.operators import blocklist as B
from leakscope.operators import impact as I
from leakscope.plans import delivery_queries, facts, sample, source_queries, stage
from leakscope.sinks import tables as T

TEXTS = ("business_unit", "placement", "raw_value", "app_id", "strategy_name", "click_url",
         "preview_url")


@pytest.fixture
def unstaged(monkeypatch):
    """No table has been staged yet, for the time of the test."""
    monkeypatch.setattr(stage, "_written", {})


@pytest.fixture
def shuffled(spark):
    """No side of a join is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged_names():
    return {name for _, _, name in stage._written}


def test_lines_are_not_shuffled_for_customers(spark, shuffled):
    """Customers meet orders: nothing of a line is below the exchange by customer."""
    text = plan(sample.delivery(spark, SMALL, clustered=True))
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "hashpartitioning(o_custkey" in x)
    deep = re.search(r"[+:]-", lines[at]).start()
    below = []
    for line in lines[at + 1:]:
        if re.search(r"[+:]-", line).start() <= deep:
            break
        below.append(line)
    assert any("orders.parquet" in x for x in below)
    assert not any("lineitem.parquet" in x for x in below)


@pytest.mark.parametrize("fact, key", [
    (lambda s: sample.delivery(s, SMALL, clustered=True), "l_partkey"),
    (lambda s: sample.creative(s, SMALL), "l_suppkey")])
def test_facts_are_rebalanced_before_they_carry_texts(spark, fact, key):
    """One exchange, by the key that its rows are written by, which no built text goes through."""
    lines = plan(fact(spark)).splitlines()
    found = [i for i, x in enumerate(lines) if "REBALANCE" in x]
    assert len(found) == 1 and f"hashpartitioning({key}" in lines[found[0]]
    assert not [x for x in lines[found[0]:] for t in TEXTS if f"AS {t}#" in x]


def test_tables_without_order_texts_read_no_orders(spark, unstaged):
    """Recommendations, exchanges and leaks stage the placements, not all of delivery."""
    text = plan(sample.delivery(spark, SMALL, *sample.placement_columns(), clustered=True))
    assert not re.search(r"/(orders|customer|nation)\.parquet", text)
    run = delivery_queries.QUERIES
    for name in ("exchange_summary", "leak_offenders", "block_candidates_app", "drop_excluded"):
        assert run[name][0](spark, SMALL).count() > 0
    assert "placements" in staged_names() and "delivery" not in staged_names()


def test_delivery_serves_as_placements_once_written(spark, unstaged):
    whole = facts.delivery(spark, SMALL).select(*sample.placement_columns())
    part = facts.placements(spark, SMALL)
    assert "placements" not in staged_names() and part.columns == whole.columns
    stage._written.clear()
    alone = facts.placements(spark, SMALL)
    assert "placements" in staged_names()
    assert alone.exceptAll(whole).count() == 0 and whole.exceptAll(alone).count() == 0


def test_arriving_exports_are_no_single_tasks(spark, unstaged, monkeypatch, tmp_path):
    """Each of the three exports of the feed is written as several files and judged as one batch."""
    made = iter([str(tmp_path / "run")])
    monkeypatch.setattr(source_queries, "fresh_path", lambda spark, name: next(made))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # so that small rows make several files as well
    try:
        facts.creative(spark, SMALL)
    finally:
        spark.conf.set(merge, "true")
    alert = source_queries.QUERIES["incremental_creative_alerts"][0](spark, SMALL)
    assert alert.count() > 0
    assert len(list((tmp_path / "run/in").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "run/out/summary")).select("batch_id").count() == 3


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    return set(re.findall(r"shuffle_\d+_\d+_0\.data", blocks.diskBlockManager().getAllFiles().mkString(",")))


def shuffled_sums(spark):
    rows = spark.range(0, 20000, 1, 8).selectExpr("id % 100 AS k", "id AS v")
    return rows.groupBy("k").sum("v").withColumnRenamed("sum(v)", "v")


@pytest.mark.parametrize("write", [
    lambda df, path: stage.staged(df.sparkSession, path, "sums", lambda: df),
    lambda df, path: lineage.written(df, "sums"),
    lambda df, path: T.write_table(df, path, "csv")])
def test_written_tables_leave_no_shuffles(spark, unstaged, tmp_path, write):
    """Disks hold the shuffles of the write at work, not those of all writes so far."""
    before = shuffle_files(spark)
    write(shuffled_sums(spark), str(tmp_path / "out"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)  # they are removed in the background
    assert not left


def test_only_own_writes_drop_shuffles(spark):
    """The setting holds during the write alone, and also ends with one that fails."""
    before = spark.conf.get(lineage.CLEANUP, None)
    with pytest.raises(ValueError):
        with lineage.shuffles_dropped(spark):
            assert spark.conf.get(lineage.CLEANUP) == "true"
            raise ValueError
    assert spark.conf.get(lineage.CLEANUP, None) == before
    df = shuffled_sums(spark)
    assert df.count() == 100 and len(df.collect()) == 100 and len(df.collect()) == 100


@pytest.mark.parametrize("name, grain", [
    ("ctr_after_recs_partner", "partner"), ("ctr_after_recs_client", "client"),
    ("partner_watchlist", "partner"), ("watchlist_export_partner", "partner"),
    ("watchlist_export_client", "client")])
def test_watch_lists_stage_what_they_need(spark, unstaged, name, grain):
    """No days, campaigns or exchanges of delivery, and no other grain than their own."""
    run = delivery_queries.QUERIES | source_queries.QUERIES
    run[name][0](spark, SMALL).count()
    names = staged_names()
    assert {"watched", f"after_recs_{grain}"} <= names
    assert not names & ({"delivery", "placements", "after_recs"} | {
        f"after_recs_{g}" for g in I.AFTER_GRAINS if g != grain})
    assert facts.watched(spark, SMALL).columns == facts.WATCHED


def test_delivery_serves_the_watch_lists_once_written(spark, unstaged):
    whole = facts.delivery(spark, SMALL).select(*facts.WATCHED)
    part = facts.watched(spark, SMALL)
    assert "watched" not in staged_names()
    stage._written.clear()
    alone = facts.watched(spark, SMALL)
    assert "watched" in staged_names()
    for other in (part, alone):
        assert other.exceptAll(whole).count() == 0 and whole.exceptAll(other).count() == 0


def test_all_lists_share_one_delivery_and_one_scan_of_grains(spark, unstaged):
    assert source_queries.QUERIES["watchlist_export"][0](spark, SMALL).count() > 0
    names = staged_names()
    assert {"delivery", "after_recs"} <= names and "watched" not in names
    assert not names & {f"after_recs_{g}" for g in I.AFTER_GRAINS}


def test_a_grain_alone_equals_its_rows_among_all(spark):
    """Also where dimensions are null, keys are null and a row has no impressions."""
    rows = [
        ("site", "a", None, "P1", "C1", "CTV", "S1", 100, 1), ("site", "a", None, "P1", None, "CTV", "S1", 50, 2),
        ("site", "b", None, None, "C1", "CTV", None, 30, 3), ("app", "x", "id1", "P2", "C1", None, "S2", 20, 0),
        ("app", "y", None, "P2", "C2", "Video", "S2", 10, 1), ("site", "a", None, "P1", "C1", "CTV", "S1", 100, 1),
        ("site", None, None, "P3", "C3", "Video", "S3", 0, 0), ("app", "x", " ID1", "P1", "C2", "Video", "S1", 7, 7)]
    delivery = spark.createDataFrame(
        rows, "placement_type string, placement string, app_id string, business_unit string, client string, "
        "product string, strategy_name string, impressions long, clicks long")
    keys = spark.createDataFrame([("a",), ("id1",)], "match_key string")
    both = I.after_recs(delivery, keys)
    assert both.columns == I.after_recs(delivery, keys, list(I.AFTER_GRAINS)).columns
    for name, dims in I.AFTER_GRAINS.items():
        alone = I.after_recs(delivery, keys, [name])
        assert alone.columns == ["grain", *dims, "ctr_after_recs", "pct_impr_on_recs"]
        got, whole = (sorted(map(str, I.of_grain(x, name).collect())) for x in (alone, both))
        assert got == whole and got


def test_block_list_has_a_known_size(spark, unstaged):
    """It is written before it is joined, so no plan has to guess how large its groups are."""
    text = plan(delivery_queries.key_blocklist(spark, SMALL))
    assert "Exchange" not in text and "FileScan parquet" in text and "blocklist" in staged_names()


def block_rows(spark):
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame(
        [("a", "All Products", day, day, None, None, None), ("b", "CTV", day, None, None, day, None)],
        "match_key string, lists string, date_added date, since_all_products date, since_audio date, "
        "since_ctv date, since_social_mirror date")


def test_exposure_needs_no_days(spark):
    rows = spark.createDataFrame(
        [("site", "A", None, "P", "CTV", 5), ("site", "b", None, "P", "Video", 7),
         ("site", "b", None, "P", "CTV", 1), ("site", "a", None, None, "CTV", 9),
         ("site", "c", None, "P", "CTV", 9), ("site", "a", None, "P", None, 2)],
        "placement_type string, placement string, app_id string, business_unit string, product string, "
        "impressions long")
    got = [tuple(r) for r in B.blocklist_exposure_by_bu(rows, block_rows(spark)).collect()]
    assert got == [("P", 8, 2)]


def test_known_products_of_a_campaign_are_one_number(spark):
    """Nine products do not make nine columns of the shuffled groups; unknown and null ones count as none."""
    day = datetime.date(2021, 1, 1)
    rows = spark.createDataFrame(
        [("U", "C", "S", c, product, "site", place, None, "direct", 10, 1, 2.0, day)
         for c, product, place in [("1", "Video", "a"), ("1", "CTV", "b"), ("1", "Line item", "a"),
                                   ("2", None, "a"), ("2", "Line item", "b"), ("3", "Audio", "a")]],
        "business_unit string, client string, strategy_name string, campaign_id string, product string, "
        "placement_type string, placement string, app_id string, dsp string, impressions long, clicks long, "
        "spend double, served_date date")
    table = B.clients_on_blocked(rows, block_rows(spark))
    assert {r.strategy_id: r.products for r in table.collect()} == {"1": "CTV, Video", "2": "", "3": "Audio"}
    shuffles = [x for x in plan(table).splitlines() if "partial_bool_or" in x or "partial_bit_or" in x]
    assert shuffles and not any(x.count("bool_or((product") > 0 for x in shuffles)
